"""Approximate nearest neighbours (10): shifted space-filling curves.

Each of several curves projects the vectors on a few directions, shifts the grid and orders all rows by their Hilbert
keys. A curve is cut into blocks at keys taken from a sample of its rows; Spark deals every row to its block on each curve
and every query to the blocks around its own, and the best of all curves merge.

Nearness is cosine, so the curves order the vectors' directions: each vector is divided by its length first. Directions of a
curve are drawn by the covariance, so heavy axes have more of it. A grid reaches from all directions there can be down to
cells of FINEST, however small or far off a cluster is: rows of one finest cell score alike to within a double's rounding,
so no group of different vectors is left in the order of its ids.

The index covers every row. How many curves there are and how wide a window along each is follows from the vectors: for a sample of
PROBES rows the true neighbours are searched among all rows, their distances along up to CURVES curves are counted, and
the cheapest choice that finds TARGET of them is taken. Clustered vectors need few and narrow windows; vectors without
structure need windows that hold much of the table, and get them. ``tests/llm/test_search.py`` measures both.

Vectors of one direction are indexed once, by their smallest id, and stand for all their ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hilbert import hilbert_bytes
from .storage import ROW, numbered, small, stored, without
from .top_k import usable

#: Directions of a curve's grid (eight at most), bits of its middle part of 4.4 standard deviations, and the seed of all curves.
DIRECTIONS, BITS, SEED = 8, 4, 11
#: Width of the finest cells: cosines of directions nearer than 1e-8 differ by less than a double holds.
FINEST = 1e-9
#: Rows whose neighbours fit the index, the share of these that it is to find, and the numbers of curves that are tried.
PROBES, TARGET, CURVES = 256, 0.96, (2, 3, 4, 6, 8, 12, 16)
#: Share of the table beyond which comparing a query costs more than its time, in proportion.
SHARE = 0.1
#: Rows of a block at most, and sampled rows for each block that place its borders.
BLOCK, BORDER_ROWS = 8192, 16
#: Rows of a window at least: fewer are not worth a task.
LEAST = 256
#: Microseconds to move a row to a block, and to compare two rows.
MOVING, COMPARING = 12.0, 0.02


class Plan(NamedTuple):
    """Curves, rows of a block, and blocks on each side of its own that a query is compared with."""

    curves: int
    block: int
    reach: int


class Grid:
    """The projections and grids of some curves."""

    def __init__(self, mean: np.ndarray, cov: np.ndarray, curves: int, directions: int = DIRECTIONS, bits: int = BITS, seed: int = SEED):
        d = len(mean)
        m = min(directions, d)
        rng = np.random.default_rng(seed)
        heavy, turn = np.linalg.eigh(cov + 1e-9 * max(np.trace(cov), 1e-9) / d * np.eye(d))
        root = turn * np.sqrt(np.maximum(heavy, 0))
        self.axes, self.step, self.zero = [], [], []
        for _ in range(curves):
            axes = np.linalg.qr(root @ rng.normal(size=(d, m)))[0]
            width = 4.4 * np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", axes, cov, axes), 1e-12)) / (1 << bits)
            self.axes.append(axes)
            self.step.append(width)
            self.zero.append(mean @ axes - width * rng.uniform(-1, 1, m))
        widths = np.concatenate(self.step)
        # two directions are 2 apart at most; the shift adds a cell
        self.above = max(bits - 1, int(np.ceil(np.log2(2 / widths.min() + 2))))
        self.below = max(0, int(np.ceil(np.log2(widths.max() / FINEST))))
        self.bits = self.above + 1 + self.below

    def keys(self, x: np.ndarray, rows: np.ndarray, curves: int) -> list[np.ndarray]:
        """For each of the first curves, the keys of directions ``x`` as byte strings, which end in the rows' numbers, so that none are equal."""
        ends = rows.astype(">u8").view(np.uint8).reshape(-1, 8)
        out = []
        for a, z, w in zip(self.axes[:curves], self.zero, self.step, strict=False):
            cells = np.floor(((x @ a - z) / w + (1 << self.above)) * (1 << self.below)).astype(np.int64)
            key = np.hstack([hilbert_bytes(np.clip(cells, 0, (1 << self.bits) - 1), self.bits), ends])
            out.append(np.ascontiguousarray(key).view(f"V{key.shape[1]}").ravel())
        return out


def _places(borders: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How many of the sorted ``borders`` are not above each key."""
    both = np.concatenate([borders, keys])
    parts = both.view(np.uint8).reshape(len(both), -1)
    parts = np.hstack([parts, np.zeros((len(both), -parts.shape[1] % 8), np.uint8)]).view(">u8")
    order = np.lexsort(parts.T[::-1])  # stable: a border comes before an equal key
    passed = np.cumsum(order < len(borders))
    out = np.empty(len(both), np.int64)
    out[order] = passed
    return out[len(borders) :]


def _sorted(keys: np.ndarray) -> np.ndarray:
    parts = keys.view(np.uint8).reshape(len(keys), -1)
    parts = np.hstack([parts, np.zeros((len(keys), -parts.shape[1] % 8), np.uint8)]).view(">u8")
    return keys[np.lexsort(parts.T[::-1])]


def _vectors(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _directions(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that squares neither overflow nor vanish and multiples of a row are equal."""
    if not len(x):
        return x
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _moments(vectors: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of all directions, from sums over partitions."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.hstack([_directions(_vectors(batch.column(0))), np.ones((batch.num_rows, 1))])
            total += x.T @ x
        i, j = np.repeat(np.arange(d + 1), d + 1), np.tile(np.arange(d + 1), d + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "s"])

    got = vectors.select("v").mapInArrow(sums, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    total = np.zeros((d + 1, d + 1))
    for r in got:
        total[r["i"], r["j"]] = r["s"]
    n = max(total[d, d], 1)
    mean = total[d, :d] / n
    return mean, total[:d, :d] / n - np.outer(mean, mean)


def _probes(vectors: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Numbers and directions of PROBES rows and their true neighbours among all rows, and the pairs of these."""
    spark = vectors.sparkSession
    asked = vectors.orderBy(F.xxhash64(ROW, F.lit(3)), ROW).limit(PROBES).select(ROW, "v").collect()
    asked_rows = np.array([r[ROW] for r in asked], np.int64)
    q = _directions(np.array([r["v"] for r in asked], float))
    shared = spark.sparkContext.broadcast((asked_rows, q))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        top, of = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(0).to_numpy()
            s = q @ _directions(_vectors(batch.column(1))).T
            s[own[:, None] == rows] = -np.inf
            s, rows = np.hstack([top, s]), np.hstack([of, np.tile(rows, (len(q), 1))])
            take = np.argsort(-s, axis=1, kind="stable")[:, :k]
            top, of = np.take_along_axis(s, take, 1), np.take_along_axis(rows, take, 1)
        i, j = np.nonzero(of >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(of[i, j]), pa.array(top[i, j])], names=["q", "c", "s"])

    order = Window.partitionBy("q").orderBy(F.desc("s"), "c")
    near = vectors.select(ROW, "v").mapInArrow(best, "q long, c long, s double").withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).collect()
    wanted = spark.createDataFrame([(c,) for c in {r["c"] for r in near}], f"{ROW} long")
    found = vectors.join(F.broadcast(wanted), ROW).select(ROW, "v").collect()  # PROBES x k at most
    rows = np.concatenate([asked_rows, np.array([r[ROW] for r in found], np.int64)])
    x = np.vstack([q, _directions(np.array([r["v"] for r in found], float).reshape(-1, q.shape[1]))])
    at = {r[ROW]: len(q) + i for i, r in enumerate(found)}
    return rows, x, q, [(r["q"], at[r["c"]]) for r in near]


def fitted(vectors: DataFrame, grid: Grid, n: int, k: int, share: float) -> Plan:
    """The cheapest numbers of curves, rows and blocks by which TARGET of the probes' true neighbours are met; those that compare more than SHARE
    of the table are dearer. ``share``: queries by rows."""
    rows, x, _, pairs = _probes(vectors, k)
    curves = max(CURVES)
    keys = grid.keys(x, rows, curves)
    shared = vectors.sparkSession.sparkContext.broadcast((grid, [_sorted(c) for c in keys]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, marks = shared.value
        total = np.zeros((curves, len(marks[0]) + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                own = grid.keys(_directions(_vectors(batch.column(1))), batch.column(0).to_numpy(), curves)
                for c in range(curves):
                    total[c] += np.bincount(_places(marks[c], own[c]), minlength=total.shape[1])
        c, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(at), pa.array(total[c, at])], names=["curve", "at", "n"])

    between = np.zeros((curves, len(rows) + 1))
    for r in vectors.select(ROW, "v").mapInArrow(count, "curve long, at long, n long").groupBy("curve", "at").agg(F.sum("n").alias("n")).collect():
        between[r["curve"], r["at"]] = r["n"]
    ranks = [np.cumsum(between[c])[_places(_sorted(keys[c]), keys[c]) - 1] for c in range(curves)]
    a, b = np.array(pairs, np.int64).reshape(-1, 2).T
    apart = np.array([np.abs(r[a] - r[b]) for r in ranks])
    plans = []
    for c in CURVES:
        window = int(np.quantile(apart[:c].min(0), TARGET)) + 1 if len(a) else n
        window = min(max(window, LEAST, round(n**0.5)), n)
        block = min(window, BLOCK)
        reach = -(-window // block)
        met = min(n, (2 * reach + 1) * block)
        plans.append((max(1.0, c * met / n / SHARE) * c * (MOVING * (1 + share * (2 * reach + 1)) + COMPARING * share * met), Plan(c, block, reach)))
    return min(plans)[-1]


def _dealt(vectors: DataFrame, grid: Grid, plan: Plan, n: int, compared: DataFrame) -> DataFrame:
    """curve, block, query, row, vec_id and v of every row in its block, and of each query in all blocks around its own."""
    step = max(1, plan.block // BORDER_ROWS)
    spark = vectors.sparkSession

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for c, key in enumerate(grid.keys(_directions(_vectors(batch.column(1))), batch.column(0).to_numpy(), plan.curves)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), c)), pa.array([k.tobytes() for k in key], pa.binary())], names=["curve", "key"])

    # about BORDER_ROWS x n / block rows: their number grows with the root of the table's, as blocks do
    sampled = vectors.where(F.pmod(F.xxhash64(ROW, F.lit(5)), F.lit(step)) == 0).select(ROW, "v").mapInArrow(some, "curve long, key binary")
    every = max(1, round(plan.block / step))
    numbered_keys = sampled.withColumn("at", F.row_number().over(Window.partitionBy("curve").orderBy("key")))
    borders: list[list[bytes]] = [[] for _ in range(plan.curves)]
    for r in numbered_keys.where(F.col("at") % every == 0).orderBy("curve", "key").toLocalIterator():
        borders[r["curve"]].append(bytes(r["key"]))
    size = len(grid.keys(np.ones((1, len(grid.axes[0]))), np.zeros(1, np.int64), 1)[0][0].tobytes())
    shared = spark.sparkContext.broadcast((grid, [np.frombuffer(b"".join(x), f"V{size}") for x in borders]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, marks = shared.value
        names = ["curve", "block", "query", "row", "vec_id", "v"]
        for batch in batches:
            if not batch.num_rows:
                continue
            x, asked = _directions(_vectors(batch.column(2))), np.flatnonzero(batch.column(3).to_numpy(zero_copy_only=False))
            for c, key in enumerate(grid.keys(x, batch.column(0).to_numpy(), plan.curves)):
                block = _places(marks[c], key)
                around = block[asked][:, None] + np.arange(-plan.reach, plan.reach + 1)
                ok = (around >= 0) & (around <= len(marks[c]))
                q, _ = np.nonzero(ok)
                of = pa.array(np.concatenate([np.arange(len(block)), asked[q]]))
                query = np.concatenate([np.zeros(len(block), bool), np.ones(len(q), bool)])
                blocks = np.concatenate([block, around[ok]])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), c)), pa.array(blocks), pa.array(query), *(batch.column(i).take(of) for i in (0, 1, 2))], names=names)

    kind = vectors.schema["v"].dataType.simpleString()
    both = vectors.join(compared, ROW, "left").select(ROW, "vec_id", "v", F.coalesce("query", F.lit(False)).alias("query"))
    return both.mapInArrow(deal, f"curve long, block long, query boolean, row long, vec_id long, v {kind}")


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in an order of operations that depends on the two rows alone."""
    x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def best_pairs(queries: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the query, number of the row and cosine of each query's k nearest rows; equal cosines by smaller ids.

    Products of matrices may differ by their shapes in the last bits, so they only tell which rows can be among the k;
    these get their cosines one by one."""
    if not len(x) or not len(queries):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    u, out = _directions(x), []
    for part in np.array_split(np.arange(len(queries)), -(-len(queries) * len(x) // (1 << 22))):
        s = _directions(queries[part]) @ u.T
        take = min(k, len(x))
        kth = np.partition(s, len(x) - take, axis=1)[:, len(x) - take, None]
        q, c = np.nonzero(s >= kth - 1e-14)
        score = np.concatenate([cosines(queries[part][q[i : i + 65_536]], x[c[i : i + 65_536]]) for i in range(0, len(q), 65_536)])
        o = np.lexsort((ids[c], -score, q))
        q, c, score = q[o], c[o], score[o]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        out.append((part[q[keep]], c[keep], score[keep]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def nearest(df: DataFrame, every: int = 50, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", plan: Plan | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found by cosine for each query (ids divisible by ``every``), nearest first.

    Ties go to smaller ids; all candidates if there are fewer. Rows with null ids, vectors that are null, zero or hold null or
    non-finite components, and vectors of another length than the commonest take no part. A query is not its own candidate; rows that
    repeat an id and its vector count once. Without ``plan``, it is ``fitted``."""
    spark = df.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable("v")).where(F.exists("v", lambda x: x != 0))
    most = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    direction = F.transform("v", lambda x: x.cast("double") / F.col("__most") + 0.0)
    rows = rows.withColumn("__most", most).withColumn("__u", direction).select("vec_id", "v", F.xxhash64("__u").alias("h1"), F.xxhash64(F.lit(1), "__u").alias("h2"))
    rows = numbered(rows, "vectors")
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], result)
    d = common["d"]
    rows = rows.where(F.size("v") == d)
    # a direction's rows: the one with the smallest id stands for it, the k + 1 smallest ids can be among its neighbours
    narrow = rows.select("h1", "h2", "vec_id", ROW)
    classes = stored(narrow.groupBy("h1", "h2").agg(F.min(F.struct("vec_id", ROW)).alias("least"), F.count("*").alias("n")), "directions")
    n = classes.count()
    several = small(stored(classes.where("n > 1").select("h1", "h2", F.col(f"least.{ROW}").alias("row")), "shared-directions"))
    of = stored(narrow.join(several, ["h1", "h2"], "left").select("vec_id", ROW, F.coalesce("row", ROW).alias("row")), "members")
    single = without(rows, ROW, of.where(F.col(ROW) != F.col("row")).select(ROW)).select(ROW, "vec_id", "v")
    asked = of.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "row").distinct()
    compared = small(stored(asked.select(F.col("row").alias(ROW), F.lit(True).alias("query")).distinct(), "queries"))
    grid = Grid(*_moments(single, d), max(CURVES))
    plan = plan or fitted(single, grid, n, k, compared.count() / max(n, 1))

    def rerank(table: pa.Table) -> pa.Table:
        order = table.column("query").to_numpy()
        row, ids, x = table.column("row").to_numpy(), table.column("vec_id").to_numpy(), _vectors(table.column("v").combine_chunks())
        q, c, s = best_pairs(x[order], ids[~order], x[~order], k + 1)
        return pa.table({"q": row[order][q], "c": row[~order][c], "id": ids[~order][c], "score": s})

    found = _dealt(single, grid, plan, n, compared).groupBy("curve", "block").applyInArrow(rerank, "q long, c long, id long, score double")
    pairs = stored(found, "pairs").distinct()
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id", "c")
    near = pairs.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1).select("q", "c", "score")
    by_id = Window.partitionBy("row").orderBy("vec_id")
    members = of.select("row", "vec_id").distinct().withColumn("at", F.row_number().over(by_id)).where(F.col("at") <= k + 1)
    ids = near.join(members, F.col("c") == F.col("row")).select("q", "vec_id", "score")
    # the k + 1 nearest ids of a query's direction: one of them may be the query's own
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    lists = ids.withColumn("at", F.row_number().over(by_score)).where(F.col("at") <= k + 1)
    lists = lists.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "score"))).alias("near"))  # k + 1 at most
    own = F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))
    out = asked.join(lists, F.col("row") == F.col("q")).select("query_id", F.posexplode(F.slice(own, 1, k)).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")
