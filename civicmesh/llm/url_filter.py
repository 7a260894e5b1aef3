"""URL filters (6): path-template trees.

Every url is a host and a path of segments. Per host, numbers, ids and other variable segments become
wildcards; sibling branches with statistically similar children merge into one wildcard branch; each template
gets the labels of the urls below it (from the domain rules) and is rejected if its smoothed share of blocked ones
is high. Rules that fit a url decide it; templates decide the rest. No Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

#: (verdict, host, path): a rule fits its host and all subdomains if the url's path starts with the rule's.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Pseudo-counts of the purity and how many of them are blocked, and the share of blocked urls from which a template is rejected: it takes
#: two labels at least.
SMOOTHING, PRIOR, REJECT = 4.0, 0.25, 0.5
#: Siblings merge only if their purities differ from their parent's by SIMILAR at most, and their child shares by as much (total
#: variation) or no more than chance allows: chi-square within DEVIATIONS of its mean.
SIMILAR, DEVIATIONS = 0.25, 3.0


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; null or without ``://``: both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one, and its verdict; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def generalised(segment: Column) -> Column:
    """A segment with its variable parts as wildcards: digits, long hexadecimal ids; a file ending stays."""
    out = F.regexp_replace(segment, r"^[0-9a-fA-F]{8,}(?=\.|$)|^[0-9a-fA-F-]{32,}(?=\.|$)", "*")
    return F.regexp_replace(out, r"[0-9]+", "*")


def segments(path: Column) -> Column:
    """All segments of a path, generalised."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), generalised)


def pure(blocked: str, labelled: str) -> Column:
    """The smoothed share of blocked urls among the labelled ones; urls that no rule fits say nothing."""
    return (F.col(blocked) + SMOOTHING * PRIOR) / (F.col(labelled) + SMOOTHING)


def _level(paths: DataFrame, d: int) -> DataFrame:
    """``paths`` (host, segs, n, labelled, blocked, tail) with the template of segment d put before each tail."""
    here = paths.where(F.size("segs") > d).withColumns({"parent": F.concat_ws("/", F.slice("segs", 1, d)), "seg": F.get("segs", F.lit(d)), "child": F.coalesce(F.get("tail", F.lit(0)), F.lit(""))})
    node, branch = ["host", "parent"], ["host", "parent", "seg"]
    cells = stored(here.groupBy(*branch, "child").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]), "url-cells")
    own = cells.groupBy(*branch).agg(F.sum("n").alias("n0"), F.sum("labelled").alias("l0"), F.sum("blocked").alias("b0"), F.bool_or(F.col("child") != "").alias("inner"))
    whole = own.groupBy(*node).agg(F.sum("n0").alias("all"), F.sum("l0").alias("l"), F.sum("b0").alias("b"), F.count("*").alias("wide"))
    pool = cells.groupBy(*node, "child").agg(F.sum("n").alias("m"))
    kinds = pool.groupBy(*node).agg(F.count("*").cast("double").alias("k"), (F.sum("m") * F.sum(1 / F.col("m"))).alias("inverse"))
    q, p = F.col("n") / F.col("n0"), F.col("m") / F.col("all")
    # children that a branch lacks add their whole share to the total variation and nothing to the sum of q * q / p
    gaps = cells.join(own, branch).join(whole, node).join(pool, [*node, "child"]).groupBy(*branch).agg(((F.sum(F.abs(q - p) - p) + 1) / 2).alias("apart"), (F.first("n0") * (F.sum(q * q / p) - 1)).alias("chi"))
    k = F.col("k")
    spread = F.sqrt(F.greatest(F.lit(0.0), 2 * (k - 1) + (F.col("inverse") - k * k - 2 * k + 2) / F.col("n0")))
    chance = (F.col("all") * SIMILAR**2 >= 1) & (F.col("chi") - (k - 1) <= DEVIATIONS * spread + 1e-6)  # few urls prove nothing
    mine, theirs = pure("b0", "l0"), pure("b", "l")
    alike = (F.abs(mine - theirs) <= SIMILAR) & ((mine >= REJECT) == (theirs >= REJECT))
    merged = (F.col("wide") > 1) & alike & (chance | (F.col("inner") & (F.col("apart") <= SIMILAR)))
    named = stored(gaps.join(own, branch).join(whole, node).join(kinds, node).select(*branch, merged.alias("merged")), "url-branches")
    stays = named.where(~F.col("merged") & (F.col("seg") == "*")).select(*node, F.lit("**").alias("wild"))  # a variable branch that stays apart keeps its name
    named = named.join(stays, node, "left").select(*branch, F.when(F.col("merged"), F.coalesce("wild", F.lit("*"))).otherwise(F.col("seg")).alias("name"))
    done = here.join(named, branch).withColumn("tail", F.concat(F.array("name"), "tail")).select(*paths.columns)
    return done.unionByName(paths.where(F.size("segs") <= d))


def templates(urls: DataFrame) -> DataFrame:
    """``urls`` (host, segs, n, labelled, blocked: a row for each host and generalised path) with the template of each.

    From the deepest level of the data up, a branch merges with its parent's others into one wildcard if its child shares and its
    purity are like the parent's overall; a branch that would be rejected never merges into an allowed parent, nor the reverse."""
    deepest = urls.agg(F.max(F.size("segs"))).first()[0] or 0
    tree = urls.withColumn("tail", F.array().cast("array<string>"))
    for d in reversed(range(deepest)):
        tree = stored(_level(tree, d), "url-level")
    short = F.repeat(F.lit("/"), F.when(F.size("segs") < 2, 1).otherwise(0))
    return tree.select(*urls.columns, F.concat(F.array_join("tail", "/"), short).alias("template"))


def judge(pages: DataFrame, url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, teaches: Column | None = None) -> DataFrame:
    """``pages`` with host, path, rule, template, learned and verdict (allow or block); its own columns of these names give way.

    ``learned`` is what the url's template alone says, ``verdict`` the rule's word or else that. ``teaches`` (of columns of ``pages``): urls
    whose rules label their templates, all by default.
    Null urls and ones without ``://`` have empty host and path and are judged like any other: no rule fits, and their template has
    no labels, so they are allowed. Repeated rows stay and count each."""
    rest = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "template", "learned", "verdict")]
    host, path = parse(F.col(f"`{url}`"))
    parsed = pages.select(*rest, host.alias("host"), path.alias("path"), F.coalesce(F.lit(True) if teaches is None else teaches, F.lit(False)).alias("__teaches"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": name, "__label": verdict, "__segs": segments(F.col("path"))})
    # the tree has a row for each host and generalised path: counted before anything is shuffled by host
    label = F.when(F.col("__teaches"), F.col("__label"))
    sums = {"n": F.count("*"), "labelled": F.count(label), "blocked": F.count(F.when(label == "block", 1))}
    counts = stored(parsed.groupBy("host", F.col("__segs").alias("segs")).agg(*(v.alias(k) for k, v in sums.items())), "url-counts")
    tree = stored(templates(counts), "url-templates")
    whole = tree.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in sums])
    purity = whole.select("host", "template", (pure("blocked", "labelled") >= REJECT).alias("__bad"))
    judged = tree.join(purity, ["host", "template"]).select(F.col("host").alias("__host"), F.col("segs").alias("__path"), "template", "__bad")
    out = parsed.join(judged, (F.col("host") == F.col("__host")) & (F.col("__segs") == F.col("__path")), "left")
    learned = F.when(F.col("__bad"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(*rest, "host", "path", "rule", "template", learned.alias("learned"), F.coalesce("__label", learned).alias("verdict"))
