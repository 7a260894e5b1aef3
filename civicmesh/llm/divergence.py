"""Source divergence audit (11): how far the words of a source are from those of the others and of its language.

Single-pass in-memory indexing. A task builds a block of postings (language, source, term -> count, documents) until its
memory is full and spills it as a run: a row for each language and hash shard, with its postings sorted by term and
packed. Each shard merges its runs by a heap, FAN at a time, until one is left: the frequencies. A merged run that is
to be merged again is dealt to FAN times as many shards, so no task ever holds many more postings than a block has.
From the frequencies come, by grouping, each group's size and how many terms it has how often.

A pair's distance sums over all kept terms, nearly all of which at least one of the two never uses. With f(p, q) the
distance at a term, p0 a group's p at count zero, and K the terms that a group has:
sum over terms of g of f(p_g, p0_h), the same of h, (V - K_g - K_h) f(p0_g, p0_h), and a correction for each term that both
have. The first two need how many terms a group has so and so often, the corrections are streamed over the postings
and added up by pair in each task, so that no pairs of a term are ever rows.

All numbers are exact integers.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import small, stored

#: Postings of a block until it is spilled, bytes of one text that are cut into words at a time, bits of FAN (runs that a
#: heap merges at a time, and shards that each is dealt to), and pairs that a task gathers before it sends them on.
BLOCK, CHUNK, FAN_BITS, PAIRS = 3 << 18, 1 << 20, 8, 1 << 20
FAN = 1 << FAN_BITS
#: Fixed value: one whole in the contract's integer probabilities.
ONE = 1_000_000_000
#: Bytes of terms: letters, lower-cased, and all beyond ASCII; the rest separates.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A run's part for a shard; without a segment: the sources of a language in the run.
RUN = "lang string, run long, shard long, sources array<string>, segment binary"
FREQUENCIES = "lang string, term binary, sources array<string>, counts array<long>"


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of about CHUNK bytes."""
    text = text.translate(LETTERS)
    start = 0
    while len(text) - start > CHUNK and (cut := text.find(b" ", start + CHUNK)) >= 0:
        yield text[start:cut].split()
        start = cut
    yield text[start:].split()


def _packed(columns: list[pa.Array]) -> bytes:
    """term, source (a place in the row's sources), count and documents, as a compressed Arrow stream."""
    batch = pa.RecordBatch.from_arrays(columns, names=["term", "source", "count", "df"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _dealt(lang: str, run: int, bits: int, sources: list[str], columns: list[pa.Array], crc: np.ndarray) -> Iterator[tuple]:
    """Rows of RUN of postings with the terms' hashes: one for each shard, sorted by term."""
    shard = crc >> (32 - bits)
    order = pc.sort_indices(pa.table([pa.array(shard), columns[0]], names=["shard", "term"]), sort_keys=[("shard", "ascending"), ("term", "ascending")])
    columns, shard = [c.take(order) for c in columns], shard[order.to_numpy()]
    ends = np.append(np.flatnonzero(np.diff(shard)) + 1, len(shard)).tolist() if len(shard) else []
    for start, end in zip([0, *ends], ends, strict=False):
        yield lang, run, int(shard[start]), sources, _packed([c.slice(start, end - start) for c in columns])


class Block:
    """Postings in memory."""

    def __init__(self):
        self.counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
        self.df: dict[tuple[str, str], Counter] = defaultdict(Counter)
        self.size = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        counts, df = self.counts[lang, source], self.df[lang, source]
        before, seen = len(counts), None
        for words in _words(text):
            counts.update(words)
            seen = set(words) if seen is None else seen.union(words)
        df.update(seen)
        self.size += len(counts) - before

    def run(self, number: int, bits: int = FAN_BITS) -> Iterator[tuple]:
        """The block as a run."""
        for lang in sorted({lang for lang, _ in self.counts}):
            groups = sorted(group for group in self.counts if group[0] == lang)
            sources = [source for _, source in groups]
            yield lang, number, -1, sources, None
            keys = [list(self.counts[g]) for g in groups]
            columns = [
                pa.concat_arrays([pa.array(k, pa.binary()) for k in keys]),
                pa.array(np.repeat(np.arange(len(groups), dtype=np.int32), [len(k) for k in keys])),
                pa.array(np.concatenate([np.fromiter(self.counts[g].values(), np.int64) for g in groups])),
                pa.array(np.concatenate([np.fromiter(map(self.df[g].__getitem__, k), np.int64) for g, k in zip(groups, keys, strict=True)])),
            ]
            crc = np.concatenate([np.fromiter(map(zlib.crc32, k), np.int64) for k in keys])
            yield from _dealt(lang, number, bits, sources, columns, crc)


def _rows(rows: Iterator[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["lang", "run", "shard", "sources", "segment"])


def _spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, number = Block(), TaskContext.get().partitionId() << 24
    for batch in batches:
        for i in range(batch.num_rows):
            block.add(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
            if block.size >= BLOCK:
                yield _rows(block.run(number))
                block, number = Block(), number + 1
    yield _rows(block.run(number))


def _merged(table: pa.Table) -> tuple[list[str], list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A shard's runs merged by a heap over their terms: sources, terms, and of each posting the places of term and source, its
    count and documents, by term and source."""
    sources = sorted(set().union(*table.column("sources").to_pylist()))
    place = {s: i for i, s in enumerate(sources)}
    heads, starts, sizes, codes, counts, dfs, base = [], [], [], [], [], [], 0
    for own, segment in zip(table.column("sources").to_pylist(), table.column("segment").to_pylist(), strict=True):
        batch = pa.ipc.open_stream(segment).read_next_batch()
        term = batch.column(0)
        start = np.append(0, np.flatnonzero(pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)).to_numpy(zero_copy_only=False)) + 1)
        heads.append(zip(term.take(pa.array(start)).to_pylist(), range(len(sizes), len(sizes) + len(start))))
        sizes.extend(np.diff(np.append(start, len(term))).tolist())
        starts.append(start + base)
        codes.append(np.array([place[s] for s in own], dtype=np.int64)[batch.column(1).to_numpy()])
        counts.append(batch.column(2).to_numpy())
        dfs.append(batch.column(3).to_numpy())
        base += len(term)
    terms: list[bytes] = []
    order, of = [], []
    last = None
    for term, head in heapq.merge(*heads):
        if term != last:
            terms.append(term)
            last = term
        order.append(head)
        of.append(len(terms) - 1)
    order, start, size = np.array(order, dtype=np.int64), np.concatenate(starts), np.array(sizes, dtype=np.int64)
    length = size[order]
    rows = np.repeat(start[order] - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(base)
    key = np.repeat(np.array(of, dtype=np.int64), length) * len(sources) + np.concatenate(codes)[rows]
    key, at = np.unique(key, return_inverse=True)
    count, df = np.zeros(len(key), dtype=np.int64), np.zeros(len(key), dtype=np.int64)
    np.add.at(count, at, np.concatenate(counts)[rows])
    np.add.at(df, at, np.concatenate(dfs)[rows])
    return sources, terms, key // len(sources), key % len(sources), count, df


def _merge_again(bits: int):
    """One run of FAN runs of a shard, dealt to shards of ``bits`` bits."""

    def merge(table: pa.Table) -> pa.Table:
        sources, terms, term, source, count, df = _merged(table)
        crc = np.fromiter(map(zlib.crc32, terms), np.int64, len(terms))[term]
        columns = [pa.array(terms, pa.binary()).take(pa.array(term)), pa.array(source.astype(np.int32)), pa.array(count), pa.array(df)]
        lang, group = table.column("lang")[0].as_py(), table.column("group")[0].as_py()
        return pa.Table.from_batches([_rows(_dealt(lang, group, bits, sources, columns, crc))])

    return merge


def _merge_last(least: int):
    """The frequencies of a shard's terms that ``least`` documents have."""

    def merge(table: pa.Table) -> pa.Table:
        sources, terms, term, source, count, df = _merged(table)
        total = np.zeros(len(terms), dtype=np.int64)
        np.add.at(total, term, df)
        kept = np.flatnonzero(total >= least)
        rows = np.isin(term, kept)
        offsets = pa.array(np.append(0, np.cumsum(np.bincount(term, minlength=len(terms))[kept])).astype(np.int32))
        names = pa.array(sources, pa.string()).take(pa.array(source[rows]))
        columns = [
            pa.array([table.column("lang")[0].as_py()] * len(kept), pa.string()), pa.array(terms, pa.binary()).take(pa.array(kept)),
            pa.ListArray.from_arrays(offsets, names), pa.ListArray.from_arrays(offsets, pa.array(count[rows])),
        ]
        return pa.table(columns, names=["lang", "term", "sources", "counts"])

    return merge


def frequencies(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """lang, term, sources and counts of the terms that at least ``least`` rows of a language have, stored, and all occurring lang and source.

    ``docs`` has lang, source and text; nulls count as empty."""
    clean = [F.coalesce(F.col(c), F.lit("")) for c in ("lang", "source", "text")]
    spilled = stored(docs.select(clean[0].alias("lang"), clean[1].alias("source"), clean[2].cast("binary").alias("text")).mapInArrow(_spill, RUN), "runs")
    groups = spilled.where("segment is null").select("lang", F.explode("sources").alias("source")).distinct()
    runs, left, bits = spilled.where("segment is not null"), spilled.agg(F.count_distinct("run").alias("n")).first()["n"], FAN_BITS
    while True:
        left = -(-left // FAN)
        grouped = runs.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(max(1, left)))).groupBy("lang", "shard", "group")
        if left <= 1:
            out = stored(grouped.applyInArrow(_merge_last(least), FREQUENCIES), "frequencies")
            return out.withColumn("term", F.col("term").cast("string")), groups
        bits = min(bits + FAN_BITS, 32)
        runs = stored(grouped.applyInArrow(_merge_again(bits), RUN), "runs")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column) -> Column:
    """1 + floor(ONE * count / total) for count <= total; three digits at a time, so that products of counts below
    9 * 10 ** 15 stay longs. Null for a total of zero."""
    total = F.nullif(total, F.lit(0).cast("long"))
    out, rest = F.lit(0).cast("long"), count.cast("long")
    for _ in range(3):
        scaled = rest * F.lit(1000)
        out, rest = out * F.lit(1000) + _div(scaled, total), scaled % total
    return out + F.lit(1)


def smoothed(count: Column, n: Column, v: Column) -> Column:
    """p of a term with ``count`` occurrences among ``n`` of ``v`` kept terms."""
    return share(count + F.lit(2), n + F.lit(2) * v)


def apart(p: Column, q: Column) -> Column:
    """f(p, q)."""
    return _div((p - q) * (p - q), p + q)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over terms of f(p_g, p_h) - f(p_g, p0_h) - f(p0_g, p_h) + f(p0_g, p0_h) for each pair of groups that have them,
    in both directions, from rows of lang and postings (source, p, p0)."""
    codes: dict[tuple[str, str], int] = {}
    names: list[tuple[str, str]] = []
    keys: list[np.ndarray] = []
    sums: list[np.ndarray] = []

    def code(group: tuple[str, str]) -> int:
        if group not in codes:
            codes[group] = len(names)
            names.append(group)
        return codes[group]

    def reduced() -> None:
        unique, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(unique), dtype=np.int64)
        np.add.at(total, at, np.concatenate(sums))
        keys[:], sums[:] = [unique], [total]

    def sent() -> pa.RecordBatch:
        a, b, s = keys[0] >> 31, keys[0] & ((1 << 31) - 1), sums[0]
        keys.clear(), sums.clear()
        first, second = np.concatenate([a, b]).tolist(), np.concatenate([b, a]).tolist()
        columns = [[names[i][0] for i in first], [names[i][1] for i in first], [names[i][1] for i in second]]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(np.concatenate([s, s]))], names=["lang", "a", "b", "s"])

    for batch in batches:
        lists = batch.column(1)
        sizes = np.diff(lists.offsets.to_numpy())
        starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        flat = lists.flatten()
        source = flat.field(0).dictionary_encode()
        p, p0 = flat.field(1).to_numpy(), flat.field(2).to_numpy()
        lang = batch.column(0).dictionary_encode()
        for i, name in enumerate(lang.dictionary.to_pylist()):
            of_lang = lang.indices.to_numpy() == i
            local = np.array([-1] * len(source.dictionary), dtype=np.int64)
            at = source.indices.to_numpy()
            for m in np.unique(sizes[of_lang]).tolist():
                rows = starts[of_lang & (sizes == m)]
                step = max(1, PAIRS // m)
                for begin in range(0, len(rows), step):
                    place = rows[begin : begin + step, None] + np.arange(m)
                    who = at[place]
                    for w in np.unique(who[local[who] < 0]).tolist():
                        local[w] = code((name, source.dictionary[w].as_py()))
                    g, pg, zero = local[who], p[place], p0[place]
                    for k in range(m - 1):  # each column against all later ones
                        x, z = pg[:, k : k + 1], zero[:, k : k + 1]
                        y, zy = pg[:, k + 1 :], zero[:, k + 1 :]
                        more = _apart(x, y) - _apart(x, zy) - _apart(z, y) + _apart(z, zy)
                        low, high = np.minimum(g[:, k : k + 1], g[:, k + 1 :]), np.maximum(g[:, k : k + 1], g[:, k + 1 :])
                        keys.append(((low << 31) | high).ravel())
                        sums.append(more.ravel())
                        if sum(map(len, keys)) > 2 * PAIRS:
                            reduced()
                            if len(keys[0]) > PAIRS:
                                yield sent()
    if keys:
        reduced()
        yield sent()


def audit(df: DataFrame, least: int = 10, ranks: int = 10, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value and rank: for each source of a language ``pair`` rows (item: every other source of the
    language, by falling distance) and ``term`` rows (item: the ``ranks`` kept terms by which it stands out most).

    Null languages, sources and texts count as empty; repeated rows count each; other columns are not read. A language keeps the terms in
    at least ``least`` of its rows; one without any has pairs of distance zero. Ties go to the smaller item, by its bytes."""
    docs = df.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text"))
    table, occurring = frequencies(docs, least)
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
    each = table.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", F.col("x.sources").alias("source"), F.col("x.counts").alias("c"))
    sizes = each.groupBy("lang", "source").agg(F.sum("c").alias("n"), F.count("*").alias("k"))
    whole = table.groupBy("lang").agg(F.count("*").alias("v"), F.sum(total).alias("lang_n"))
    none = F.lit(0).cast("long")
    known = occurring.join(sizes, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0)
    groups = stored(known.withColumn("p0", smoothed(none, F.col("n"), F.col("v"))), "groups")
    of = small(groups)

    postings = table.select("lang", "term", total.alias("lang_c"), F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    postings = postings.select("lang", "term", "lang_c", F.col("x.sources").alias("source"), F.col("x.counts").alias("c")).join(of, ["lang", "source"])
    postings = stored(postings.select("lang", "source", "term", "c", "p0", smoothed(F.col("c"), F.col("n"), F.col("v")).alias("p"), smoothed(F.col("lang_c"), F.col("lang_n"), F.col("v")).alias("q")), "postings")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)

    others = of.select("lang", F.col("source").alias("b"), F.col("p0").alias("p0_b"), F.col("k").alias("k_b"))
    often = postings.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("*").alias("terms"))
    alone = often.join(others, "lang").where("a <> b").groupBy("lang", "a", "b").agg(F.sum(F.col("terms") * apart(F.col("p"), F.col("p0_b"))).alias("s"))
    both_ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    alone = alone.select("lang", "s", both_ways.alias("e")).select("lang", "e.a", "e.b", "s")
    idle = groups.select("lang", F.col("source").alias("a"), "p0", "k", "v").join(others, "lang").where("a <> b")
    idle = idle.select("lang", "a", "b", F.coalesce((F.col("v") - F.col("k") - F.col("k_b")) * apart(F.col("p0"), F.col("p0_b")), none).alias("s"))
    lists = postings.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("x")).where(F.size("x") > 1)  # a row for each source at most
    shared = lists.select("lang", "x").mapInArrow(_corrections, "lang string, a string, b string, s long")
    pairs = idle.unionByName(alone).unionByName(shared).groupBy("lang", "a", "b").agg(F.sum("s").alias("value"))
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms)
