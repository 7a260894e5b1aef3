"""Personal data in texts (12): weak-supervision aggregation over candidate spans.

Base rules find spans that stay whatever the model says. Beside them, wider candidates (one pass of one pattern, so
none overlap) get votes of five labelers: the base rule on the candidate alone, a gazetteer, the words before it, the
characters around it, and its shape. Expectation-maximisation over the counts of vote patterns estimates each
labeler's reliability for each kind, a logistic span classifier learns from the resulting posteriors, and candidates
that it accepts are added unless they overlap a base span.

All of it is DataFrame expressions: one pass over the texts gives narrow rows, one grouped count gives the patterns (a
bounded number of rows, whatever the input), and the model's weights are a few constants in the last projection.

Places are code points, ends exclusive. Patterns use possessive loops and starts that only fit where a run begins, so
that runs of any length take linear time and no stack; they match what the plain patterns in the docstring of
``base_spans`` match.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

KINDS = ("email", "ip", "card", "phone")
#: Marks around matches, and what stands for a mark that a text has itself; no pattern matches either.
MARK, STAND_IN = "\ue000", "\ue001"
#: Parts of a text that are walked through at a time.
BLOCK = 512
#: Characters before a candidate that the context labeler reads.
CONTEXT = 40
#: Gazetteers and context words by kind.
TOP_DOMAINS = "com org net edu gov mil int info biz io dev app co us uk de fr es it nl be ch at eu ca au br mx in jp cn kr se no dk fi pl pt ie ru"
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 98 351 352 353 358 420 421"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|62)"
UNROUTED = r"^(?:0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5]|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\."
SPEAKS_FOR = {
    "email": r"\b(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt)\b",
    "ip": r"\b(?:ip|host|server|address|login|from|adresse)\b",
    "card": r"\b(?:card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta)\b",
    "phone": r"\b(?:phone|tel|call|mobile|cell|fax|dial|telefon|telefono|appelez)\b",
}
SPEAKS_AGAINST = {
    "email": r"\b(?:git|ssh|user)\b",
    "ip": r"\b(?:version|release|section|chapter|v)\b",
    "card": r"\b(?:order|invoice|isbn|id|serial|tracking|number)\b",
    "phone": r"\b(?:order|invoice|version|score|sum)\b",
}
PART = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_WIDE_LOCAL, _WIDE_LABEL = r"[\p{L}\p{N}._%+'-]", r"[\p{L}\p{N}-]"
CANDIDATES = "|".join(
    (
        rf"(?:\G|(?<!{_WIDE_LOCAL})){_WIDE_LOCAL}++(?:@| ?[\[(]at[\])] ?){_WIDE_LABEL}++(?:(?:\.| ?[\[(]dot[\])] ?){_WIDE_LABEL}++)++",
        r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
        r"\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
        r"(?<![0-9]|[0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
        r"(?<![0-9])(?:[0-9]{16,19}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}(?: [0-9]{4}){3})(?![0-9])",
    )
)

#: Labelers, and sizes of the classifier's further features: eighths of length, digits in fours.
LABELERS = ("rule", "gazetteer", "context", "around", "shape")
LENGTHS, DIGITS = 6, 6
NO, YES, ABSTAINS = 0, 1, 2
#: Known beforehand, so not estimated: how often the rule fails on a real number (its form is a standard's), and how many of
#: other numbers pass a card's check digit.
MISFIT, CHANCE = 0.005, 0.1
#: Rounds of expectation-maximisation, of Newton's method, the weight of each prior count and of the ridge.
ROUNDS, NEWTON, PRIOR, RIDGE = 60, 25, 1.0, 1e-2


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _fits(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(rf"^0*{PART}(?:\.0*{PART}){{3}}$")
    if kind == "card":
        return F.length(_digits(s)).between(16, 19) & F.call_function("luhn_check", _digits(s))
    if kind == "phone":
        return F.length(_digits(s)).between(8, 15)
    return F.lit(True)


def _cut(text: Column, pattern: str) -> Column:
    """The text in parts: outside, match, outside, match, ..., outside."""
    return F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, where ``value`` is computed once."""
    return F.get(F.transform(F.array(value), lambda v: of(v)), 0)


def _walk(parts: Column, start: Column, step: Callable[[Column, Column], Column], moved: Callable[[Column, Column], Column]) -> Column:
    """What ``step`` gathers in ``out`` over the parts, with places moved from the block's to the text's beginning.

    Arrays grow by copying, so each is gathered over a block of BLOCK parts (even, so blocks begin outside a match) and
    blocks are joined at last; a text with very many matches takes little more than linear time."""

    def walked(p: Column) -> Column:
        ends = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int"))
        return F.transform(ends, lambda b: F.aggregate(F.slice(p, b * BLOCK + 1, BLOCK), start, step, lambda a: F.struct(a["at"].alias("at"), a["out"].alias("out"))))

    def joined(blocks: Column) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("starts"))
        after = lambda a, b: F.struct((a["at"] + b["at"]).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts"))
        starts = F.aggregate(blocks, zero, after, lambda a: a["starts"])
        return F.flatten(F.zip_with(blocks, starts, lambda b, by: F.transform(b["out"], lambda s: moved(s, by))))

    return _let(_let(parts, walked), joined)


def base_spans(text: Column, kind: str) -> Column:
    """Array of (start, end) of the leftmost non-overlapping matches that fit; ``text`` has no MARK.

    email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``; ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)`` with
    parts of 255 at most; card ``[0-9]([\\x20-]?[0-9])+`` with 16 to 19 digits that pass Luhn's test; phone
    ``\\+[0-9][\\x20().0-9-]+[0-9]`` with 8 to 15 digits."""
    pair = lambda start, end: F.struct(start.alias("start"), end.alias("end"))
    kept = lambda a, s, start, end: F.when(a["match"] & _fits(kind, s), F.concat(a["out"], F.array(pair(start, end)))).otherwise(a["out"])
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(False).alias("match"), none.alias("out"))

    def step(a: Column, s: Column) -> Column:
        end = a["at"] + F.length(s)
        return F.struct(end.alias("at"), (~a["match"]).alias("match"), kept(a, s, a["at"], end).alias("out"))

    may = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike("[0-9]"))
    found = _walk(_cut(text, BASE[kind]), start, step, lambda s, by: pair(s["start"] + by, s["end"] + by))
    return F.when(may, found).otherwise(none)


def _kind_of(s: Column) -> Column:
    """The kind that a candidate's own form stands for, as a place in KINDS."""
    return F.when(s.rlike("@|[(\\[]at"), F.lit(0)).when(s.rlike("^[+(]"), F.lit(3)).when(F.contains(s, F.lit(".")), F.lit(1)).otherwise(F.lit(2))


def _by_kind(kind: Column, of: Callable[[str], Column]) -> Column:
    out = F.when(kind == 0, of(KINDS[0]))
    for i, name in enumerate(KINDS[1:], 1):
        out = out.when(kind == i, of(name))
    return out


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(YES)).when(no, F.lit(NO)).otherwise(F.lit(ABSTAINS))


def _listed(words: str, word: Column) -> Column:
    return word.isin(words.split())


def _votes(kind: Column, s: Column, before: Column, after: Column) -> list[Column]:
    """One vote of each labeler on a candidate."""
    whole = {"email": s.rlike(f"^{_LOCAL}++@{_LABEL}++(?:\\.{_LABEL}++)++$")}
    rule = _by_kind(kind, lambda k: _vote(whole.get(k, _fits(k, s)), F.lit(k != "email")))
    known = {
        "email": _listed(TOP_DOMAINS, F.lower(F.substring_index(s, ".", -1))),
        "ip": ~s.rlike(UNROUTED),
        "card": _digits(s).rlike(ISSUERS),
        "phone": _listed(CALLING_CODES, F.regexp_extract(s, r"^\+([0-9]+)", 1)),
    }
    gazetteer = _by_kind(kind, lambda k: _vote(known[k], F.lit(k in ("email", "ip")) | F.startswith(s, F.lit("+")) | F.lit(k == "card")))
    near = F.lower(before)
    context = _by_kind(kind, lambda k: _vote(near.rlike(SPEAKS_FOR[k]), near.rlike(SPEAKS_AGAINST[k])))
    joined = F.substring(before, -1, 1).rlike(r"[\p{L}\p{N}_/=#]") | after.rlike(r"^(?:[\p{L}\p{N}_/=]|[.,-][0-9])")
    around = _vote(F.lit(False), joined)  # nothing around a candidate speaks for it
    shape = _by_kind(
        kind,
        lambda k: {
            "email": _vote(s.rlike(r"\p{L}.*@.*\p{L}"), ~s.rlike(r"\p{L}")),
            "ip": _vote(s.rlike(r"[0-9]{2}.*\.[0-9]{2}"), s.rlike(r"(?:^|\.)0[0-9]") | ~s.rlike("[0-9]{2}")),
            "card": _vote(s.rlike(r"^[0-9]{4}[ -]"), s.rlike(r"^([0-9])\1+$")),
            "phone": _vote(s.rlike(r"[() .-]"), F.lit(False)),
        }[k],
    )
    return [rule, gazetteer, context, around, shape]


def candidates(text: Column) -> Column:
    """Array of the candidates of a text: kind, start, end, the labelers' votes and the classifier's further features."""
    kinds = "array<struct<kind: int, start: bigint, end: bigint, votes: array<int>, length: int, digits: int>>"
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(False).alias("match"), F.lit("").alias("before"), F.array().cast("array<struct<start: bigint, end: bigint, s: string, before: string, after: string>>").alias("out"))
    each = lambda s, n: F.struct(s.alias("s"), F.substring(F.coalesce(n, F.lit("")), 1, 2).alias("n"))
    pairs = _let(_cut(text, CANDIDATES), lambda p: F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), each))

    def step(a: Column, p: Column) -> Column:
        end = a["at"] + F.length(p["s"])
        more = F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), end.alias("end"), p["s"].alias("s"), a["before"].alias("before"), p["n"].alias("after"))))
        before = F.when(a["match"], a["before"]).otherwise(F.substring(p["s"], -CONTEXT, CONTEXT))
        return F.struct(end.alias("at"), (~a["match"]).alias("match"), before.alias("before"), F.when(a["match"], more).otherwise(a["out"]).alias("out"))

    def judged(c: Column, by: Column) -> Column:
        kind = _kind_of(c["s"])
        length = F.least(F.floor(F.length(c["s"]) / 8), F.lit(LENGTHS - 1)).cast("int")
        digits = F.least(F.floor(F.length(_digits(c["s"])) / 4), F.lit(DIGITS - 1)).cast("int")
        votes = F.array(*_votes(kind, c["s"], c["before"], c["after"]))
        return F.struct(kind.alias("kind"), (c["start"] + by).alias("start"), (c["end"] + by).alias("end"), votes.alias("votes"), length.alias("length"), digits.alias("digits"))

    none = F.array().cast(kinds)
    return F.when(text.rlike(r"[0-9@]|[\[(]at"), _walk(pairs, start, step, judged)).otherwise(none).cast(kinds)


class Model:
    """Posteriors' reliabilities and the span classifier's weights: a few dozen numbers."""

    def __init__(self, reliability: np.ndarray, prior: np.ndarray, weights: np.ndarray):
        self.reliability, self.prior, self.weights = reliability, prior, weights

    def score(self, c: Column) -> Column:
        """A candidate's probability of being personal data."""
        told = F.from_json(F.lit(json.dumps([round(float(w), 9) for w in self.weights])), "array<double>")
        places = [F.lit(0), 1 + c["kind"]]
        at = 1 + len(KINDS)
        for i in range(len(LABELERS)):
            places.append(at + 3 * (len(LABELERS) * c["kind"] + i) + F.get(c["votes"], i))
        at += 3 * len(LABELERS) * len(KINDS)
        places += [at + c["length"], at + LENGTHS + c["digits"]]
        return F.lit(1.0) / (1 + F.exp(-sum((F.get(told, p) for p in places), F.lit(0.0))))


def reliabilities(kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of the vote patterns, the probability of each vote given the truth (kind, labeler, truth, vote), and each
    kind's share of personal data, by expectation-maximisation from the share of yes among the votes cast."""
    cast = (votes != ABSTAINS).sum(1)
    p = np.where(cast > 0, ((votes == YES).sum(1) + 0.5) / (cast + 1), 0.5)
    prior = np.full(len(KINDS), 0.5)
    table = np.zeros((len(KINDS), len(LABELERS), 2, 3))
    # the priors keep the classes from changing places: labelers are right more often than wrong
    believed = PRIOR * np.array([[3.0, 1.0, 1.0], [1.0, 3.0, 1.0]])
    for _ in range(ROUNDS):
        for k in range(len(KINDS)):
            mine = kinds == k
            weight = np.stack([counts[mine] * (1 - p[mine]), counts[mine] * p[mine]])
            prior[k] = (weight[1].sum() + PRIOR) / (weight.sum() + 2 * PRIOR)
            for i in range(len(LABELERS)):
                seen = np.stack([np.bincount(votes[mine, i], w, 3) for w in weight]) + believed
                table[k, i] = seen / seen.sum(1, keepdims=True)
            if KINDS[k] != "email":
                table[k, 0, 1] = [MISFIT, 1 - 2 * MISFIT, MISFIT]
            if KINDS[k] == "card":
                table[k, 0, 0] = [1 - CHANCE - MISFIT, CHANCE, MISFIT]
        logs = np.log(table)
        odds = np.log(prior / (1 - prior))[kinds]
        for i in range(len(LABELERS)):
            odds = odds + logs[kinds, i, 1, votes[:, i]] - logs[kinds, i, 0, votes[:, i]]
        p = 1 / (1 + np.exp(-odds))
    return p, table, prior


def fit(patterns: list[tuple]) -> Model:
    """The model from (kind, votes, length, digits, count) of each pattern."""
    patterns = sorted(patterns)
    kinds = np.array([r[0] for r in patterns], dtype=int)
    votes = np.array([r[1] for r in patterns], dtype=int).reshape(len(patterns), len(LABELERS))
    counts = np.array([r[4] for r in patterns], dtype=float)
    p, table, prior = reliabilities(kinds, votes, counts)
    size = 1 + len(KINDS) + 3 * len(LABELERS) * len(KINDS) + LENGTHS + DIGITS
    x = np.zeros((len(patterns), size))
    rows = np.arange(len(patterns))
    x[:, 0] = 1
    x[rows, 1 + kinds] = 1
    at = 1 + len(KINDS)
    for i in range(len(LABELERS)):
        x[rows, at + 3 * (len(LABELERS) * kinds + i) + votes[:, i]] = 1
    at += 3 * len(LABELERS) * len(KINDS)
    x[rows, at + np.array([r[2] for r in patterns], dtype=int)] = 1
    x[rows, at + LENGTHS + np.array([r[3] for r in patterns], dtype=int)] = 1
    share = counts / max(counts.sum(), 1.0)
    w = np.zeros(size)
    for _ in range(NEWTON):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - q)) - RIDGE / size * w
        curve = (x * (share * q * (1 - q))[:, None]).T @ x + RIDGE / size * np.eye(size)
        step = np.linalg.solve(curve, slope)
        w = w + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
    return Model(table, prior, w)


def learn(found: DataFrame) -> Model:
    """The model of a table with ``candidates``; its grouped patterns are at most a few thousand rows whatever the input."""
    each = found.where(F.size("candidates") > 0).select(F.explode("candidates").alias("c")).select("c.kind", "c.votes", "c.length", "c.digits")
    rows = each.groupBy("kind", "votes", "length", "digits").count().collect()
    return fit([(r["kind"], tuple(r["votes"]), r["length"], r["digits"], r["count"]) for r in rows])


def spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ``base`` and ``added`` (arrays of kind, start, end, by kind in the order of KINDS, then start) of each row.

    Null texts count as empty; repeated rows and rows without id count each; other columns are not read. A table
    without candidates gives base spans alone."""
    t = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), MARK, STAND_IN)
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), t.alias("__t"))
    of_kind = lambda i, k: F.transform(base_spans(F.col("__t"), k), lambda s: F.struct(F.lit(i).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    found = stored(rows.select("doc_id", F.concat(*(of_kind(i, k) for i, k in enumerate(KINDS))).alias("base"), candidates(F.col("__t")).alias("candidates")), "spans")
    model = learn(found)
    # most candidates are base spans themselves: these go by their hash, so only the rest is compared span by span
    key = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    accepted = F.transform(F.filter("candidates", lambda c: model.score(c) >= 0.5), key)
    fresh = F.transform(F.array_except(accepted, F.transform("base", key)), lambda k: F.split(k, ":").cast("array<bigint>"))
    spans_of = F.transform(fresh, lambda n: F.struct(F.get(n, 0).cast("int").alias("kind"), F.get(n, 1).alias("start"), F.get(n, 2).alias("end")))
    apart = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    added = F.array_sort(F.filter(spans_of, apart))
    return found.select("doc_id", "base", added.alias("added"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, the counts of base spans by kind, base_sha256, and all spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    of_kind = lambda i: F.filter("base", lambda s: s["kind"] == i)
    counts = [F.size(of_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    every = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(told(F.col("base")).cast("binary"), 256).alias("base_sha256"), told(every).alias("spans"))


def personal_data(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return digests(spans(df, doc_id, text))
