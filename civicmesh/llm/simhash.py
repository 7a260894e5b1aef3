"""SimHash near-duplicates (4): pivot distance tables.

Texts get a 64-bit fingerprint of their word shingles. Two fingerprints within ``radius`` bits agree in at
least ``kept`` of ``radius + kept`` bands, so every linked pair meets in some bucket of ``kept`` equal bands
(how many bands are kept follows from the number of distinct fingerprints, so that a bucket's expected size
stays bounded at any input size). In a bucket the pivot tables decide: the Hamming distances from each
fingerprint to a set of reference fingerprints. By the triangle inequality, linked pairs differ by at most
``radius`` in every coordinate, so a bucket sorted by the first coordinate is compared in a sliding window
only, pairs whose largest coordinate difference exceeds the radius are discarded, and survivors are verified
by the exact distance. A bucket gives a spanning forest of its links and not all of them, so copies by the
thousand cost one edge each.

Exact copies collapse before anything is paired: only distinct fingerprints are bucketed. Buckets over
``split`` rows are dealt out as pairs of chunks, each to its own task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .storage import ROW, numbered, small, stored, without
from .text_batches import map_texts

SEED = 42
#: Shingles that are hashed and counted at a time.
BLOCK = 1 << 17
#: Expected rows of a bucket beyond which another band is kept, and rows of a bucket beyond which it is split.
BUCKET, SPLIT = 4096, 16_384
#: Rows with one fingerprint from which its class is broadcast to them.
HOT = 10_000
PIVOTS = 12


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: hashes of their numbers."""
    return [xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(n)]


def fingerprint(text: bytes, words: int = 4) -> int:
    """SimHash over the XXH64 of ``words``-word shingles of UTF-8 text, A-Z lower-cased, repeats included.

    Fewer words: the whole sequence is the one shingle; none: zero. A bit is 1 if it is set in over half the hashes."""
    parts = text.lower().split()
    n = len(parts)
    if not n:
        return 0
    joined = b" ".join(parts)
    if n < words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: n - words + 1].tolist(), ends[words - 1 :].tolist()
    count, of = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(first), BLOCK):
        hashes = np.array([of(joined[a:b], SEED) for a, b in zip(first[i : i + BLOCK], last[i : i + BLOCK], strict=True)], np.uint64)
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(first), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, text: str = "text", words: int = 4, out: str = "fingerprint") -> DataFrame:
    """``df`` without ``text``, with the fingerprint as a long (its 64 bits as two's complement). Null texts count as empty."""

    def make():
        return lambda texts: [pa.array(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64), pa.int64())]

    return map_texts(df, text, [T.StructField(out, T.LongType())], make, [c for c in df.columns if c != text], binary=True)


def bands_for(distinct: int, radius: int = 4) -> tuple[int, int]:
    """Number of bands and how many of them a bucket keeps."""
    for kept in range(1, 9):
        if log2(max(distinct, 1)) - 64 * kept / (radius + kept) <= log2(BUCKET):
            break
    return radius + kept, kept


def _masks(bands: int, kept: int) -> list[int]:
    edges = [round(64 * i / bands) for i in range(bands + 1)]
    one = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(one, kept)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(group: np.ndarray, prints: np.ndarray, nodes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links inside each group; rows come sorted by group and first pivot distance."""
    n = len(prints)
    table = np.bitwise_count(prints[:, None] ^ np.array(pivots(), np.uint64)).astype(np.int16)
    parent = np.arange(n)
    active = np.arange(n)
    a, b = [], []
    step = 0
    while len(active):
        step += 1
        active = active[active + step < n]
        j = active + step
        near = (group[active] == group[j]) & (table[j, 0] - table[active, 0] <= radius)
        active, j = active[near], j[near]
        i = active
        for p in range(1, table.shape[1]):
            near = np.abs(table[i, p] - table[j, p]) <= radius
            i, j = i[near], j[near]
        near = np.bitwise_count(prints[i] ^ prints[j]) <= radius
        i, j = i[near], j[near]
        if len(i):
            new = parent[i] != parent[j]
            for x, y in zip(i[new].tolist(), j[new].tolist(), strict=True):
                rx, ry = x, y
                while parent[rx] != rx:
                    rx = parent[rx]
                while parent[ry] != ry:
                    ry = parent[ry]
                if rx != ry:
                    parent[max(rx, ry)] = min(rx, ry)
                    a.append(nodes[x])
                    b.append(nodes[y])
            while not np.array_equal(up := parent[parent], parent):
                parent = up
    return np.array(a, np.int64), np.array(b, np.int64)


def _forests(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Runs of whole groups, from batches sorted by group."""
    held: list[np.ndarray] | None = None

    def links(rows: list[np.ndarray]) -> pa.RecordBatch:
        a, b = _forest(rows[0], rows[1].view(np.uint64), rows[2], radius)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        other = np.flatnonzero(rows[0] != rows[0][-1])
        cut = int(other[-1]) + 1 if len(other) else 0  # the last group may go on in the next batch
        if cut:
            yield links([x[:cut] for x in rows])
        held = [x[cut:] for x in rows]
    if held is not None and len(held[0]):
        yield links(held)


def links(nodes: DataFrame, radius: int = 4, split: int = SPLIT) -> DataFrame:
    """Edges (a, b) between ``node`` values that connect exactly the nodes whose ``fingerprint`` values (each distinct) link."""
    bands, kept = bands_for(nodes.count(), radius)
    masks = _masks(bands, kept)
    keys = F.array(*(F.struct(F.lit(k).alias("band"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)))
    keyed = nodes.select("node", "fingerprint", F.explode(keys).alias("bucket")).select("node", "fingerprint", "bucket.band", "bucket.key")
    large = stored(keyed.groupBy("band", "key").count().where(F.col("count") > split), "large-buckets")
    if large.isEmpty():
        keyed = keyed.withColumn("pair", F.lit(0).cast("long"))
    else:
        n = F.coalesce(F.ceil(F.col("count") / split), F.lit(1)).cast("int")
        own = F.pmod(F.xxhash64("fingerprint"), F.col("n"))
        others = F.sequence(F.lit(0), F.col("n") - 1)
        pair = F.transform(others, lambda o: F.least(o, F.col("own")) * F.col("n") + F.greatest(o, F.col("own")))
        keyed = keyed.join(large, ["band", "key"], "left").withColumn("n", n).withColumn("own", own).withColumn("pair", F.explode(pair))
    first = F.bit_count(F.col("fingerprint").bitwiseXOR(F.lit(_signed(pivots(1)[0]))))
    sorted_rows = (
        keyed.select(F.xxhash64("band", "key", "pair").alias("group"), "fingerprint", "node", "band", "key", "pair", first.alias("first"))
        .repartition("group")
        .sortWithinPartitions("group", "band", "key", "pair", "first")
    )
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    # "group" stands for its bucket in the task; two buckets of one hash would only be compared as one
    found = sorted_rows.select("group", "fingerprint", "node").mapInArrow(lambda it: _forests(it, radius), schema)
    return found


def _classes(prints: DataFrame, radius: int) -> DataFrame:
    """fingerprint, class (a fingerprint that all reachable ones share), first (the least doc_id) and n (rows) of each distinct fingerprint.

    Fingerprints are the nodes, so ones that only rows without doc_id have link others like any."""
    nodes = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    found = components(stored(links(nodes.select(F.col("fingerprint").alias("node"), "fingerprint"), radius), "links"))
    found = small(stored(found.select(F.col("node").alias("fingerprint"), "component"), "classes"))
    return nodes.join(found, "fingerprint", "left").select("fingerprint", F.coalesce("component", "fingerprint").alias("class"), "first", "n")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id (the least doc_id reachable over links) of each row.

    Repeated rows keep their rows. Texts without words have fingerprint zero and link like any other; null texts count
    as empty; a row without doc_id links others, too, and gets its component's least doc_id, null if no row there has one."""
    ids = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    prints = stored(fingerprints(ids, "text", words), "fingerprints")
    classes = stored(_classes(prints, radius), "print-classes")
    linked = classes.where("class <> fingerprint").select("class").distinct()
    shared = classes.join(small(stored(linked, "linked-classes")), "class", "left_semi")
    least = small(stored(shared.groupBy("class").agg(F.min("first").alias("least")), "least-ids"))
    of = classes.join(least, "class", "left").select("fingerprint", F.coalesce("least", "first").alias("component_id"), "n")
    # fingerprints of many copies go to the rows; the others meet them by hash
    hot = F.broadcast(of.where(F.col("n") > HOT).drop("n"))  # a row for each HOT rows of the input at most
    rest = prints.join(hot.select("fingerprint"), "fingerprint", "left_anti").join(of.where(F.col("n") <= HOT).drop("n"), "fingerprint")
    out = prints.join(hot, "fingerprint").unionByName(rest)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """``df`` with one document of each component: the one with the smallest doc_id, one without doc_id only if none has any.

    Of rows that repeat the smallest doc_id one stays."""
    rows = numbered(df, "documents")
    ids = rows.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), ROW)
    prints = stored(fingerprints(ids, "text", words), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)
    best = prints.groupBy("fingerprint").agg(F.min(order).alias("best"))
    winners = _classes(prints, radius).join(best, "fingerprint").groupBy("class").agg(F.min("best").alias("best")).select(f"best.{ROW}")
    return without(rows, ROW, prints.select(ROW).join(winners, ROW, "left_anti")).drop(ROW)
