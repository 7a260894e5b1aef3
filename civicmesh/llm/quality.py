"""Quality classifier (5): random Fourier features, ridge scores, isotonic calibration.

A text becomes a few document statistics; a fixed random Fourier map of these approximates a Gaussian
kernel; each partition sums its part of the normal equations, the sums meet by rows of the matrix, and the
driver solves one small ridge system. Pooled adjacent violators over a fixed grid of scores turn ridge
scores into probabilities. Labels enter only from rows that are not held out; ids, language and source never
do.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import ROW, numbered, stored, without
from .text_batches import map_texts

#: Random features, ridge penalty for each training row, seed, grid cells of the calibration, labelled rows for each summing task.
FEATURES, RIDGE, SEED, CELLS, TASK_ROWS = 256, 1e-3, 7, 1024, 20_000
STATISTICS = (
    "log bytes", "log words", "word length", "word length spread", "upper case", "digits", "symbols", "white space", "not ASCII",
    "distinct words", "commonest word", "repeated neighbours", "repeated lines", "log line length", "symbol endings", "byte entropy",
)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


UPPER, LOWER, DIGIT, SPACE = _class(bytes(range(65, 91))), _class(bytes(range(97, 123))), _class(b"0123456789"), _class(b" \t\n\r\x0b\x0c")
PLAIN = _class(b".,;:'\"()-?")
HIGH = _class(bytes(range(128, 256)))
SYMBOL = ~(UPPER | LOWER | DIGIT | SPACE | PLAIN | HIGH)


def statistics(text: bytes) -> list[float]:
    """The STATISTICS of a whole text; an empty one has zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    size = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = counts[counts > 0] / size
    lengths = np.fromiter(map(len, words), np.int64, n)
    common = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = max(1, int(counts[UPPER].sum() + counts[LOWER].sum()))
    ends = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)
    return [
        float(np.log1p(size)), float(np.log1p(n)), float(lengths.mean()), float(lengths.std()),
        counts[UPPER].sum() / letters, counts[DIGIT].sum() / size, counts[SYMBOL].sum() / size, counts[SPACE].sum() / size, counts[HIGH].sum() / size,
        len(common) / n**0.8, max(common.values()) / n, sum(map(eq, words, words[1:])) / n, 1 - len({*lines}) / len(lines),
        float(np.log1p(size / len(lines))), float(SYMBOL[ends].mean()), float(-(share * np.log(share)).sum()),
    ]


def _array(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows, np.float64).ravel()))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, len(STATISTICS)))


def with_statistics(df: DataFrame, text: str = "text", out: str = "statistics") -> DataFrame:
    """``df`` without ``text``, with its statistics; null texts count as empty."""

    def make():
        return lambda texts: [_array(np.array([statistics(t) for t in texts]))]

    return map_texts(df, text, [T.StructField(out, T.ArrayType(T.DoubleType(), False))], make, [c for c in df.columns if c != text], binary=True)


class Model:
    """What scoring needs: a few hundred numbers, whatever the input."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.freq = rng.normal(size=(len(mean), features)) / np.sqrt(2 * len(mean) / 4)
        self.phase = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.grid = self.value = np.zeros(0)

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([np.cos(z @ self.freq + self.phase) * np.sqrt(2 / len(self.phase)), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.grid):
            return np.full(len(x), 0.5)
        return np.round(np.clip(np.interp(self.raw(x), self.grid, self.value), 0, 1), 9)  # equal texts score alike in batches of any size


def isotonic(x: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: the middle and the mean of each pool; ``x`` ascends, counts are over zero."""
    pools: list[list[float]] = []
    for a, s, n in zip(x.tolist(), sums.tolist(), counts.tolist(), strict=True):
        pools.append([s, n, a * n])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


def fit(rows: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """A model from ``statistics`` and ``label`` (0 or 1). All rows count; without any, every score is one half."""
    spark = rows.sparkSession
    d = len(STATISTICS)
    each = [f(F.col("statistics")[i]).alias(f"{n}{i}") for i in range(d) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    got = rows.agg(F.count("*").alias("n"), *each).first()
    if not got["n"]:
        return Model(np.zeros(d), np.ones(d), features, seed)
    model = Model(np.array([got[f"m{i}"] for i in range(d)]), np.array([max(got[f"s{i}"], 1e-6) for i in range(d)]), features, seed)
    shared = spark.sparkContext.broadcast(model)
    width = features + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + 1))
        for batch in batches:
            z = shared.value.features(_matrix(batch.column(0)))
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            total += z.T @ np.hstack([z, y[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), _array(total)], names=["i", "row"])

    def add(table: pa.Table) -> pa.Table:
        rows = sum(_matrix(c) .sum(0) for c in table.column("row").chunks)
        return pa.table({"i": table.column("i").slice(0, 1), "row": _array(rows[None, :])})

    schema = "i int, row array<double>"
    tasks = max(1, min(256, -(-got["n"] // TASK_ROWS)))
    parts = rows.select("statistics", "label").repartition(tasks).mapInArrow(sums, schema)
    solved = {r["i"]: r["row"] for r in parts.groupBy("i").applyInArrow(add, schema).toLocalIterator()}
    a = np.array([solved[i] for i in range(width)])
    penalty = ridge * got["n"] * np.eye(width)
    penalty[-1, -1] = 1e-9 * got["n"]
    model.weights = np.linalg.solve(a[:, :width] + penalty, a[:, width])

    shared = spark.sparkContext.broadcast(model)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CELLS, 3))
        for batch in batches:
            raw = shared.value.raw(_matrix(batch.column(0)))
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            cell = np.clip(((raw + 0.5) / 2 * CELLS).astype(int), 0, CELLS - 1)
            for k, w in enumerate((np.ones(len(y)), y, raw)):
                total[:, k] += np.bincount(cell, w, CELLS)
        used = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(total[used, k]) for k in range(3))], names=["cell", "n", "y", "x"])

    curve = rows.select("statistics", "label").mapInArrow(cells, "cell int, n double, y double, x double").groupBy("cell").agg(*(F.sum(c).alias(c) for c in "nyx")).orderBy("cell").collect()
    n, y, x = (np.array([r[c] for r in curve]) for c in "nyx")
    model.grid, model.value = isotonic(x / n, y, n)
    return model


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of the id's text leaves 0 by 5. Null ids are not held out."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _scored(df: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, extra: list[str]) -> DataFrame:
    """doc_id, the ``extra`` columns and score of each row of ``df``."""
    source = df.select(F.col(f"`{doc_id}`").alias("doc_id"), *extra, F.col(f"`{text}`").alias("text"))
    seen = stored(with_statistics(source), "statistics")
    known = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("double").alias("label"))
    known = known.where(F.col("label").isNotNull() & ~held_out())
    model = fit(stored(seen.join(known, "doc_id").select("statistics", "label"), "labelled"))
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", *extra]
    schema = T.StructType([*(seen.schema[c] for c in names), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(shared.value.score(_matrix(batch.column(len(names)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], scores], names=[*names, "score"])

    return seen.select(*names, "statistics").mapInArrow(score, schema)


def quality_scores(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (score at least ``cut``) of each row of ``df``.

    Null texts count as empty; labels that are null or of held-out rows are not read; repeated rows and labels all count."""
    scored = _scored(df, labels, doc_id, text, label, [])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", cut: float = 0.3) -> DataFrame:
    """The rows of ``df`` that the classifier does not reject, each judged by its own text, whatever its doc_id."""
    rows = numbered(df, "documents")
    scored = _scored(rows, labels, doc_id, text, label, [ROW])
    return without(rows, ROW, scored.where(F.col("score") < cut).select(ROW)).drop(ROW)
