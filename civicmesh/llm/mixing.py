"""Mixing sources to target weights (1): soft membership, nonnegative rates by projected gradients.

A classifier learned from a labelled table gives each document a posterior over domains; a document belongs to every
domain by its share. With t the token counts, p the posteriors and r the rates, the expected tokens of domain k are
sum t r p_k. The rates minimise the squared distances of these totals to the targets, each relative to its target,
under r >= 0, from r = 1.

The classifier is naive Bayes over the distinct word buckets of a text, with only those buckets that a domain has
significantly more or less often than all have. A fifth of the labelled rows teaches it no words: on these the
evidence's scale (a power of the text's length), the domains' offsets and, by pooled adjacent violators over cells of
log odds, the posteriors themselves are calibrated, weighted by tokens, so that expected totals are true totals.

The fit is the accelerated projected gradient method with restarts. In the metric of the token counts a document's
gradient is p . g with one vector g for the whole table, so rows of equal posterior have equal rates in every round.
Calibrated posteriors take few values: rows are grouped by them once, and rounds go over this table of cells until the
targets are met or rates stand still. Its rows are counted: up to NUMBERS numbers it is read by the driver, and beyond
each round is one projection of stored rates, r = max(0, q + p . y), and one aggregate of domain totals. In the end
each row takes its cell's rate.

Everything on the executors is DataFrame expressions.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import remove, stored, stored_at

#: Word buckets of the classifier, deviations from which a bucket says something of a domain, labelled rows that it learns from at most
#: (those with the smallest id hashes), one in how many of these calibrates, and domains at most.
BUCKETS, SIGNIFICANT, SAMPLE, CALIBRATES, DOMAINS = 1 << 14, 4.0, 20_000, 5, 64
#: Scales of the evidence that calibration tries: b * (distinct words) ** -power.
POWERS, SCALES = (0.0, 0.25, 0.5, 0.75, 1.0), tuple(2.0**e for e in range(-6, 7))
#: Cells of log odds between -REACH and REACH in which posteriors are calibrated.
CELLS, REACH = 64, 8.0
#: Distance of every share from its target at which the fit ends, change of every rate below which it stands still, numbers up to which
#: the driver holds the cells, and rounds (there, and over stored cells) after which not having ended is an error.
TOLERANCE, STILL, NUMBERS, ROUNDS, STORED_ROUNDS = 1e-5, 1e-8, 1 << 21, 500_000, 5_000


def words(text: Column) -> Column:
    """Lower-case words between white space; null and empty texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _numbers(values, kind: str = "double") -> Column:
    """A constant array."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


class Classifier:
    """Log shares of the significant buckets by domain, and the calibration: a few hundred kB for any input."""

    def __init__(self, domains: list[str], table: np.ndarray, bias: np.ndarray, power: float = 1.0, scale: float = 1.0, curve: np.ndarray | None = None):
        self.domains, self.table, self.bias, self.power, self.scale, self.curve = domains, table, bias, power, scale, curve

    def evidence(self, buckets: Column) -> list[Column]:
        """The sum of a text's buckets for each domain: plain sums over the few significant ones."""
        telling = F.filter(buckets, lambda b: F.get(_numbers((np.abs(self.table).max(1) > 0).tolist(), "boolean"), b))
        summed = lambda k: F.aggregate(telling, F.lit(0.0), lambda s, b: s + F.get(_numbers(self.table[:, k].round(5).tolist()), b))
        return [summed(k) for k in range(len(self.domains))]


def _posterior(evidence: np.ndarray, size: np.ndarray, power: float, scale: float, bias: np.ndarray) -> np.ndarray:
    z = evidence * (scale * np.maximum(size, 1.0) ** -power)[:, None] + bias
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _cells(p: np.ndarray) -> np.ndarray:
    odds = np.log(np.maximum(p, 1e-12) / np.maximum(1 - p, 1e-12))
    return np.clip(((odds + REACH) / (2 * REACH) * CELLS).astype(int), 0, CELLS - 1)


def _pooled(sums: np.ndarray, weights: np.ndarray, prior: float) -> np.ndarray:
    """Ascending means of the cells by pooled adjacent violators; cells without rows take the nearest pool's."""
    pools: list[list[float]] = []
    for cell in np.flatnonzero(weights).tolist():
        pools.append([sums[cell], weights[cell], cell])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, w, _ = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += w
    if not pools:
        return np.full(CELLS, prior)
    starts, values = np.array([p[2] for p in pools]), np.array([p[0] / p[1] for p in pools])
    return values[np.maximum(np.searchsorted(starts, np.arange(CELLS), side="right") - 1, 0)]


def calibrated(model: Classifier, evidence: np.ndarray, size: np.ndarray, tokens: np.ndarray, domain: np.ndarray) -> Classifier:
    """The model with the scale, offsets and curve under which these rows' true domains are likeliest, weighted by tokens."""
    n, k = evidence.shape
    weight = np.maximum(tokens, 1.0)
    truth = np.eye(k)[domain]
    share = np.maximum(weight @ truth / weight.sum(), 1e-9)
    best = (np.inf, 1.0, 1.0, np.log(share))
    for power in POWERS:
        for scale in SCALES:
            bias = np.log(share)
            for _ in range(20):  # offsets under which mean posteriors are true shares
                p = _posterior(evidence, size, power, scale, bias)
                bias = bias + np.log(share / np.maximum(weight @ p / weight.sum(), 1e-9))
            p = _posterior(evidence, size, power, scale, bias)
            loss = -float(weight @ np.log(np.maximum(p[np.arange(n), domain], 1e-12)))
            best = min(best, (loss, power, scale, bias), key=lambda x: x[0])
    _, power, scale, bias = best
    cells = _cells(_posterior(evidence, size, power, scale, bias))
    curve = [_pooled(np.bincount(cells[:, j], weight * truth[:, j], CELLS), np.bincount(cells[:, j], weight, CELLS), share[j]) for j in range(k)]
    return Classifier(model.domains, model.table, bias, power, scale, np.maximum(curve, 1e-6).round(7))


def learn(docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", domain: str = "domain") -> Classifier:
    """From at most SAMPLE rows of ``labelled`` (doc_id, domain) whose documents are in ``docs``; rows with a null in either do not count.

    Without any, there is one domain, named ``none``, to which all belongs. More than DOMAINS domains are an error."""
    ids = docs.select(F.col(f"`{doc_id}`").alias("__id")).dropna().distinct()
    known = labelled.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{domain}`").cast("string").alias("__domain")).dropna()
    known = stored(known.join(ids, "__id", "left_semi").orderBy(F.xxhash64("__id"), "__id", "__domain").limit(SAMPLE), "labelled")
    texts = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__text")).join(F.broadcast(known), "__id")
    texts = texts.withColumn("__all", F.transform(words(F.col("__text")), bucket))
    calibrates = F.pmod(F.xxhash64("__id", F.lit(7)), F.lit(CALIBRATES)) == 0
    rows = texts.select("__domain", F.size("__all").alias("tokens"), F.array_distinct("__all").alias("buckets"), calibrates.alias("calibrates"))
    rows = stored(rows, "labelled-buckets")
    sizes = {r["__domain"]: r["n"] for r in rows.groupBy("__domain").agg(F.count("*").alias("n")).limit(DOMAINS + 1).collect()}
    if len(sizes) > DOMAINS:
        raise ValueError(f"more than {DOMAINS} domains")
    domains = sorted(sizes) or ["none"]
    k = len(domains)
    taught = rows.where(~F.col("calibrates"))
    found = np.zeros((BUCKETS, k))
    for r in taught.select("__domain", F.explode("buckets").alias("b")).groupBy("__domain", "b").count().collect():  # BUCKETS x domains at most
        found[r["b"], domains.index(r["__domain"])] = r["count"]
    shares = np.maximum(found.sum(0), 1) / max(found.sum(), 1)
    whole = found.sum(1, keepdims=True)
    expected = whole * shares
    table = np.log((found + 2 * shares + 1e-9) / (expected + 2 * shares + 1e-9))
    table[np.abs(found - expected) < SIGNIFICANT * np.sqrt(expected + 1)] = 0
    n = sum(sizes.values()) or 1
    model = Classifier(domains, table, np.log([sizes.get(d, 1) / n for d in domains]))
    held = rows.where("calibrates").select("__domain", "tokens", F.size("buckets").alias("size"), F.array(*model.evidence(F.col("buckets"))).alias("e")).collect()
    if k < 2 or not held:
        return model
    column = lambda name: np.array([r[name] for r in held], float)
    return calibrated(model, column("e").reshape(-1, k), column("size"), column("tokens"), np.array([domains.index(r["__domain"]) for r in held]))


def _normal(p: str) -> Column:
    return F.transform(p, lambda x: x / F.aggregate(p, F.lit(0.0), lambda a, b: a + b))


def memberships(df: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """``df`` without ``text``, with ``tokens`` and ``posterior`` (array in the order of the model's domains)."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (text, "tokens", "posterior")]
    # each projection uses the one below several times, so Spark keeps them apart and computes each once
    out = df.select(*rest, F.transform(words(F.col(f"`{text}`")), bucket).alias("__all"))
    out = out.select(*rest, F.size("__all").cast("long").alias("tokens"), F.array_distinct("__all").alias("__buckets"))
    by = F.lit(model.scale) * F.pow(F.greatest(F.size("__buckets"), F.lit(1)).cast("double"), F.lit(-model.power))
    logits = [e * by + F.lit(float(b)) for e, b in zip(model.evidence(F.col("__buckets")), model.bias, strict=True)]
    out = out.select(*rest, "tokens", F.array(*logits).alias("posterior"))
    out = out.withColumn("posterior", F.transform("posterior", lambda x: F.exp(x - F.array_max("posterior"))))
    out = out.withColumn("posterior", _normal("posterior"))
    if model.curve is not None:
        cell = lambda p: F.least(F.greatest(F.floor((F.log(F.greatest(p, F.lit(1e-12)) / F.greatest(1 - p, F.lit(1e-12))) + REACH) / (2 * REACH) * CELLS), F.lit(0)), F.lit(CELLS - 1)).cast("int")
        curves = [F.get(_numbers(c.tolist()), cell(F.get("posterior", i))) for i, c in enumerate(model.curve)]
        out = out.withColumn("posterior", F.array(*curves)).withColumn("posterior", _normal("posterior"))
    return out


class _Held:
    """Cells on the driver."""

    rounds = ROUNDS

    def __init__(self, rows: list, total: float):
        self.posterior = np.array([r["posterior"] for r in rows], float)
        self.share = np.array([r["tokens"] for r in rows], float) / total
        self.rate = self.ahead = np.ones(len(rows))

    def tried(self, added: list[float]) -> tuple[np.ndarray, float]:
        """Domain totals after a projected step, and the largest change of a rate."""
        self.new = np.maximum(0, self.ahead + self.posterior @ added)
        return (self.share * self.new) @ self.posterior, float(np.abs(self.new - self.rate).max())

    def taken(self, on: float) -> None:
        self.rate, self.ahead = self.new, self.new + on * (self.new - self.rate)

    def again(self) -> None:
        self.ahead = self.rate

    def result(self, spark) -> DataFrame:
        return F.broadcast(spark.createDataFrame([(p, r) for p, r in zip(self.posterior.tolist(), self.rate.tolist(), strict=True)], "posterior array<double>, rate double"))


class _Stored:
    """Cells in the shared folder; each step writes their rates anew and removes the table before."""

    rounds = STORED_ROUNDS

    def __init__(self, cells: DataFrame, total: float, k: int):
        self.spark, self.k = cells.sparkSession, k
        share = F.col("tokens") / F.lit(total)
        self.rows, self.at = stored_at(cells.select("posterior", share.alias("share"), F.lit(1.0).alias("rate"), F.lit(1.0).alias("ahead")), "rates")

    def tried(self, added: list[float]) -> tuple[np.ndarray, float]:
        p = [F.get("posterior", i) for i in range(self.k)]
        step = F.greatest(F.lit(0.0), sum((x * F.lit(float(v)) for x, v in zip(p, added, strict=True)), F.col("ahead")))
        self.new, self.new_at = stored_at(self.rows.withColumn("new", step), "rates")
        w = F.col("share") * F.col("new")
        got = self.new.agg(*(F.sum(w * x).alias(f"s{i}") for i, x in enumerate(p)), F.max(F.abs(F.col("new") - F.col("rate"))).alias("change")).first()
        return np.array([got[f"s{i}"] for i in range(self.k)]), got["change"]

    def taken(self, on: float) -> None:
        remove(self.spark, self.at)
        ahead = F.col("new") + F.lit(on) * (F.col("new") - F.col("rate"))
        self.rows, self.at = self.new.select("posterior", "share", F.col("new").alias("rate"), ahead.alias("ahead")), self.new_at

    def again(self) -> None:
        remove(self.spark, self.new_at)
        self.rows = self.rows.withColumn("ahead", F.col("rate"))

    def result(self, spark) -> DataFrame:
        return self.rows.select("posterior", "rate")


def fit_rates(members: DataFrame, targets: list[float]) -> tuple[DataFrame, list[float]]:
    """posterior and rate of each posterior among ``members`` (tokens, posterior), and the shares of expected domain tokens that
    these give, of all tokens at rate one. A fit that does not end is an error."""
    spark, k = members.sparkSession, len(targets)
    cells = stored(members.groupBy("posterior").agg(F.sum("tokens").cast("double").alias("tokens")), "cells")
    size = cells.agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).first()
    total = size["t"] or 0.0
    if not total:
        return cells.select("posterior", F.lit(1.0).alias("rate")), [0.0] * k
    goal = np.array(targets)
    weight = 1 / np.maximum(goal, 1e-3)
    p = [F.get("posterior", i) for i in range(k)]
    w = F.col("tokens") / F.lit(total)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = cells.agg(*(F.sum(w * x).alias(f"s{i}") for i, x in enumerate(p)), *(F.sum(w * p[i] * p[j]).alias(f"g{i}_{j}") for i, j in pairs)).first()
    gram = np.array([[got[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    reach = 1 / np.linalg.eigvalsh(gram * np.sqrt(np.outer(weight, weight))).max()
    state = _Held(cells.orderBy("posterior").collect(), total) if size["n"] * (k + 1) <= NUMBERS else _Stored(cells, total, k)

    shares = ahead = np.array([got[f"s{i}"] for i in range(k)])
    loss, inertia = float(weight @ (shares - goal) ** 2), 1.0
    for _ in range(state.rounds):
        if np.abs(shares - goal).max() <= TOLERANCE:
            break
        after, change = state.tried((reach * weight * (goal - ahead)).tolist())
        new_loss = float(weight @ (after - goal) ** 2)
        if new_loss > loss and inertia > 1:  # overshot: again from the rates before, without inertia
            state.again()
            inertia, ahead = 1.0, shares
            continue
        then = (1 + (1 + 4 * inertia**2) ** 0.5) / 2
        on = (inertia - 1) / then
        state.taken(on)
        shares, ahead, loss, inertia = after, after + on * (after - shares), new_loss, then
        if change <= STILL:
            break
    else:
        raise RuntimeError(f"rates did not converge in {state.rounds} rounds: shares {shares.tolist()} for targets {goal.tolist()}")
    return state.result(spark), shares.tolist()


def normalized(targets: dict[str, float], domains: list[str], epochs: float = 1.0) -> list[float]:
    """Shares in the order of ``domains``; a domain without a target has zero, and targets sum to ``epochs``."""
    total = sum(max(0.0, targets.get(d, 0.0)) for d in domains)
    return [epochs * (max(0.0, targets.get(d, 0.0)) / total if total else 1 / len(domains)) for d in domains]


def copies(value: Column, doc_id: Column, seed: int = 42) -> Column:
    """A rate as a whole number of copies: rounded down or up by a number drawn from the document's id, so that the mean is the rate."""
    return F.floor(value + F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))).cast("int")


def mix_rates(df: DataFrame, labelled: DataFrame, targets: dict[str, float], doc_id: str = "doc_id", text: str = "text", epochs: float = 1.0) -> DataFrame:
    """doc_id, tokens, domain (likeliest), p_<domain>, rate and copies of each row of ``df``; repeated rows count each.

    ``labelled`` has doc_id and domain; ``targets`` gives domains' shares of the mixture, which has ``epochs``
    times the tokens of ``df``. The rates' expected totals meet targets that can be reached within TOLERANCE; others as nearly as least squares allow. Texts without words
    have no tokens and the membership of a text that says nothing."""
    model = learn(df, labelled, doc_id, text)
    members = memberships(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), model)
    members = stored(members, "memberships")
    rates, _ = fit_rates(members, normalized(targets, model.domains, epochs))
    best = F.get(F.array(*map(F.lit, model.domains)), (F.array_position("posterior", F.array_max("posterior")) - 1).cast("int"))
    shares = [F.round(F.get("posterior", i), 6).alias(f"p_{d}") for i, d in enumerate(model.domains)]
    rated = members.join(rates, "posterior").select("doc_id", "tokens", best.alias("domain"), *shares, "rate")
    return rated.withColumn("copies", copies(F.col("rate"), F.col("doc_id")))


def mix(df: DataFrame, labelled: DataFrame, targets: dict[str, float], doc_id: str = "doc_id", text: str = "text", epochs: float = 1.0) -> DataFrame:
    """``df`` with every row as often as its rate says, columns unchanged; see ``mix_rates``.

    Memberships are computed once and written beside the rows, so no row needs a key."""
    model = learn(df, labelled, doc_id, text)
    rows = df.withColumns({"__id": F.col(f"`{doc_id}`"), "__text": F.col(f"`{text}`")})
    rows = rows.withColumnsRenamed({c: f"__c{i}" for i, c in enumerate(df.columns)})
    members = stored(memberships(rows, model, "__text"), "memberships")
    rates, _ = fit_rates(members, normalized(targets, model.domains, epochs))
    n = copies(F.col("rate"), F.col("__id"))
    repeated = members.join(rates, "posterior").withColumn("__copy", F.explode(F.array_repeat(F.lit(1), n)))
    return repeated.select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(df.columns)))
