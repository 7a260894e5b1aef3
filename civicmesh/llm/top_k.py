"""Exact top-k search (7): Fagin's threshold algorithm over sorted lists for each dimension.

Vectors become integers floor(scale * x). Candidates are dealt into blocks and queries into batches, and each
pair of both is a task's group. A block has a list of its rows for each dimension, in coordinates turned to the block's
principal directions, so that few lists carry most of the scores. Sorted access takes rows
from both ends of the lists that leave most open, to a depth that doubles; rows seen are scored in full (random access). A query's
bound is the score that a row would have with the next value of each list on the side that the query's sign
asks for. The query stops when its kth score is above the bound, as then no unseen row can enter, not even by a
tie.

Every query meets one block first; the kth score found there goes along to all others, where it stops the search from
the first value of the lists on. Each group gives its best, and the best of all groups are the answer. On vectors without
structure no bound falls below a kth score before all rows are seen, as any exact search must then see them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

#: Candidates of a block and queries of a batch; depth of the first access; scores that are held at a time.
BLOCK, BATCH, FIRST_DEPTH, CELLS = 65_536, 8192, 2, 1 << 22
#: Bytes of the integers of a block at most.
BLOCK_BYTES = 65_536 * 64 * 8
LONGS = (-(1 << 63), (1 << 63) - 1)


def integers(vector: str, scale: int = 256):
    """Components floor(scale * x) as longs, x as double."""
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))


def usable(vector: str):
    """Whether a vector is not null and all its components are finite."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))


def exact(rows: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as the fastest numbers in which no sum of their products is rounded: doubles, longs, or Python's integers."""
    top = lambda x: max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    most = top(rows) * top(queries) * max(1, rows.shape[1])
    kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object
    return rows.astype(kind), queries.astype(kind)


class Lists:
    """A block's sorted lists in the turned coordinates; ``rows`` ascend by id."""

    def __init__(self, rows: np.ndarray):
        x = rows.astype(np.float64)
        size = max(np.abs(x).max(), 1.0) if x.size else 1.0
        self.turn = np.linalg.eigh((x / size).T @ (x / size))[1]
        self.at = x @ self.turn
        self.order = np.argsort(self.at, axis=0, kind="stable").astype(np.int32)
        #: More than rounding can add to a product with a query of length one.
        self.margin = 1e-9 * np.sqrt((x * x).sum(1)).max() if x.size else 0.0

    def bound(self, queries: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score that no row beyond ``depth`` from both ends of each list exceeds, and how much each list leaves open, on average."""
        n, d = self.at.shape
        q = queries.astype(np.float64)
        turned = q @ self.turn
        high, low = self.at[self.order[n - depth - 1, np.arange(d)], np.arange(d)], self.at[self.order[depth, np.arange(d)], np.arange(d)]
        top = (turned * np.where(turned > 0, high, low)).sum(1) + self.margin * np.sqrt((q * q).sum(1)) + 1e-6
        return top, np.abs(turned).mean(0) * (high - low)

    def ends(self, depth: np.ndarray) -> np.ndarray:
        """The rows up to ``depth`` from both ends of each list."""
        n = len(self.at)
        parts = [self.order[:k, j] for j, k in enumerate(depth)] + [self.order[n - k :, j] for j, k in enumerate(depth)]
        return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int32)


def threshold_search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query number, row number and score of each query's k best rows with another id, ties to smaller ids; and the rows seen.

    ``rows`` are integers and ascend by id. ``floors`` are scores that a query's kth has elsewhere: rows below them may be left out."""
    n, d = rows.shape
    rows, queries = exact(rows, queries)
    lists = Lists(rows)
    floors = np.full(len(queries), -np.inf) if floors is None else floors.astype(np.float64)
    seen = np.zeros(n, bool)
    live = np.arange(len(queries))
    best: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, rows.dtype))]
    kth = floors.copy()
    half = -(-n // 2)  # both ends to this depth are the whole list
    depth = np.zeros(d, np.int64)
    while not seen.all():
        if d:
            top, left = lists.bound(queries[live], depth) if len(live) else (kth[live], depth)
            live = live[kth[live] <= top]
            # the lists that leave most open go on, twice as deep; others wait until they matter
            depth = np.where(left >= left.mean(), np.minimum(half, np.maximum(FIRST_DEPTH, 2 * depth)), depth)
        if not len(live):
            break
        new = lists.ends(depth) if d and (depth < half).all() else np.arange(n)
        new = new[~seen[new]]
        seen[new] = True
        if not len(new):
            continue
        for part in np.array_split(live, -(-len(live) * len(new) // CELLS)):
            q, c, s = _best_of(queries[part] @ rows[new].T, query_ids[part][:, None] == ids[new], kth[part], k)
            best.append((part[q], new[c], s))
        q, c, s = (np.concatenate(x) for x in zip(*best, strict=True))
        o = np.argsort(c, kind="stable")
        for key in (-s, q):
            o = o[np.argsort(key[o], kind="stable")]
        q, c, s = q[o], c[o], s[o]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        best = [(q[place < k], c[place < k], s[place < k])]
        last = place == k - 1
        least = s[last].astype(np.float64)  # rounded, unless the sums are doubles: one step lower it is surely not too high
        kth[q[last]] = np.maximum(kth[q[last]], least if s.dtype == np.float64 else np.nextafter(least, -np.inf))
    return *best[0], int(seen.sum())


def _best_of(scores: np.ndarray, own: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and scores of each row's k best columns that are not ``own`` and not below its floor; of equal ones the first."""
    able = ~own & (scores >= floors[:, None])
    if scores.shape[1] > k:
        held = np.where(able, scores, scores.min() - 1)
        kth = np.partition(held, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
        over, tied = able & (held > kth), able & (held == kth)
        able = over | (tied & (np.cumsum(tied, axis=1) <= k - over.sum(1, keepdims=True)))
    q, c = np.nonzero(able)
    return q, c, scores[q, c]


def _vectors(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def top_k(df: DataFrame, every: int = 50, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256, block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query (ids divisible by ``every``) with the other rows.

    Ties go to smaller ids; all candidates if there are fewer. Rows with null ids, and vectors that are null or hold null or non-finite
    components, take no part. Vectors are only compared with others of their length. Rows that repeat an id are candidates each, but
    not for queries with that id; as queries each has a list of its own under that id. Sums are exact; one beyond the range of a long is given as the nearest long."""
    source = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("v")).where(F.col("vec_id").isNotNull() & usable("v"))
    source = source.select("vec_id", integers("v", scale).alias("v"), F.size("v").alias("dims"))
    is_query = F.col("vec_id") % every == 0
    sizes = source.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.max("dims").alias("dims")).first()
    block = max(1, min(block, BLOCK_BYTES // (8 * max(sizes["dims"] or 1, 1))))
    blocks, batches = max(1, -(-sizes["n"] // block)), max(1, -(-sizes["q"] // batch))
    spot = F.xxhash64("vec_id", F.lit(1))
    own_block, own_batch = F.pmod(spot, F.lit(blocks)), F.pmod(F.shiftrightunsigned(spot, 7), F.lit(batches))
    of_batches = F.transform(F.sequence(F.lit(0), F.lit(batches - 1)), lambda b: b.cast("long"))
    schema = "q long, query_id long, vec_id long, score long"

    def search(table: pa.Table) -> pa.Table:
        dims = table.column("dims")[0].as_py()
        asked, number = table.column("query").to_numpy(), table.column("q").to_numpy()
        ids, rows = table.column("vec_id").to_numpy(), _vectors(table.column("v"), dims)
        floors = table.column("floor").to_numpy().astype(np.float64)
        order = np.argsort(ids, kind="stable")
        ids, rows, asked, floors, number = ids[order], rows[order], asked[order], floors[order], number[order]
        if not asked.any() or asked.all():
            return pa.table({name: pa.array([], pa.int64()) for name in ("q", "query_id", "vec_id", "score")})
        floors = np.where(np.abs(floors) < 2.0**53, floors, np.nextafter(floors, -np.inf))
        floors[floors <= LONGS[0]] = -np.inf  # none
        q, c, s, _ = threshold_search(ids[~asked], rows[~asked], ids[asked], rows[asked], k, floors[asked])
        return pa.table({"q": number[asked][q], "query_id": ids[asked][q], "vec_id": ids[~asked][c], "score": pa.array([*map(int, np.clip(s, *LONGS))] if s.dtype == object else s.astype(np.int64), pa.int64())})

    candidates = source.select("vec_id", "v", "dims", own_block.alias("block"), F.explode(of_batches).alias("batch"), F.lit(False).alias("query"), F.lit(LONGS[0]).alias("floor"), F.lit(-1).cast("long").alias("q"))
    # rows that share an id are queries each, so they go by a number of their own
    queries = stored(source.where(is_query).withColumn("q", F.monotonically_increasing_id()), "queries")
    first_block = F.pmod(F.col("batch"), F.lit(blocks))
    asked = queries.withColumn("batch", own_batch)
    first = asked.select("vec_id", "v", "dims", first_block.alias("block"), "batch", F.lit(True).alias("query"), F.lit(LONGS[0]).alias("floor"), "q")
    meets_first = candidates.where(F.col("block") == first_block)
    found = meets_first.unionByName(first).groupBy("dims", "block", "batch").applyInArrow(search, schema)
    if blocks > 1:
        found = stored(found, "first-block")
        kth = found.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        others = F.filter(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b.cast("long")), lambda b: b != F.pmod(F.col("batch"), F.lit(blocks)))
        rest = asked.join(kth, "q", "left")
        rest = rest.select("vec_id", "v", "dims", F.explode(others).alias("block"), "batch", F.lit(True).alias("query"), F.coalesce("kth", F.lit(LONGS[0])).alias("floor"), "q")
        more = candidates.where(F.col("block") != first_block).unionByName(rest).groupBy("dims", "block", "batch").applyInArrow(search, schema)
        found = found.unionByName(more)
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
