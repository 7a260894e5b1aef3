import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from civicmesh.llm import divergence


def plain(rows, least, ranks):
    count, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        count[lang, source].update(words)
        df[lang].update(set(words))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        n = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        of = lambda c, total: 1 + 10**9 * (c + 2) // (total + 2 * len(kept))  # noqa: E731, B023
        p = {(s, t): of(count[lang, s][t], n[s]) for s in sources for t in kept}
        q = {t: of(sum(count[lang, s][t] for s in sources), sum(n.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s, t], p[o, t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s, t], q[t])) for t in kept if count[lang, s][t] and p[s, t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items[:most])}
    return out


def rows_of(seed, n):
    rng = random.Random(seed)
    words = [*"abcdefghij", "Ab", "aB", "é", "É", "ñandú", "x1y", "don't", "  ", "\x00q", "😀z", "ab-cd", "K"]
    return [(rng.choice(["en", "en", "en", "de", None, ""]), rng.choice(["s0", "s0", "s1", "s2", "é", "Z", None]), " ".join(rng.choices(words, k=rng.randrange(60)))) for _ in range(n)]


def run(spark, rows, least=3, ranks=4, parts=5):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, n int, term string").repartition(parts)
    out = [tuple(r) for r in divergence.audit(df, least, ranks).collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_against_a_plain_version(spark):
    rows = rows_of(1, 150)
    rows += [("xx", "a", None), ("xx", "b", "one two"), ("yy", "only", "one one"), ("en", "none", ""), ("en", "s0", "Solo " * 50)]
    assert run(spark, rows) == plain(rows, 3, 4)


def blocks(rows, size):
    for start in range(0, len(rows), size):
        block = divergence.Block()
        for lang, source, text in rows[start : start + size]:
            block.add(lang or "", source or "", (text or "").encode())
        yield start, block


def told(table, lang, shard):
    """Postings of a shard, by the plain way."""
    out = {}
    for r in table.to_pylist():
        if r["lang"] == lang and r["shard"] == shard and r["segment"]:
            terms = pa.ipc.open_stream(r["segment"]).read_next_batch().to_pylist()
            assert terms == sorted(terms, key=lambda x: x["term"])
            for x in terms:
                of = out.setdefault((x["term"], r["sources"][x["source"]]), [0, 0])
                of[0] += x["count"]
                of[1] += x["df"]
    return out


def test_runs_merge_to_what_one_block_holds(monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK", 16)
    rows = [r for r in rows_of(2, 90)]
    whole = pa.Table.from_batches([divergence._rows(b.run(n, 2)) for n, b in blocks(rows, 1000)])
    runs = pa.Table.from_batches([divergence._rows(b.run(n, 2)) for n, b in blocks(rows, 7)])
    for lang in ("en", "de", ""):
        for shard in range(4):
            mine = [i for i, r in enumerate(runs.to_pylist()) if r["lang"] == lang and r["shard"] == shard]
            assert told(whole, lang, shard) == told(runs, lang, shard)
            if not mine:
                continue
            group = runs.take(mine).append_column("group", pa.array([5] * len(mine)))
            again = divergence._merge_again(4)(group)
            assert set(again.column("run").to_pylist()) == {5} and {s >> 2 for s in again.column("shard").to_pylist()} == {shard}
            fine = {}
            for s in set(again.column("shard").to_pylist()):
                fine |= told(again, lang, s)
            assert fine == told(whole, lang, shard)
            last = {(r["term"], s): c for r in divergence._merge_last(4)(group).to_pylist() for s, c in zip(r["sources"], r["counts"], strict=True)}
            df = Counter()
            for (term, _), (_, n) in fine.items():
                df[term] += n
            assert last == {k: c for k, (c, _) in fine.items() if df[k[0]] >= 4}


def test_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(divergence, "FAN", 2)  # read on the driver alone: three rounds for five runs
    rows = rows_of(3, 60)
    assert run(spark, rows, 2, 3) == plain(rows, 2, 3)


def test_pairs_gathered_in_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "PAIRS", 4)
    rng = random.Random(4)
    lists = [[{"source": s, "p": rng.randrange(1, 10**9), "p0": 1000 + ord(s[0])} for s in rng.sample(["a", "b", "c", "d", "e"], k)] for k in (2, 3, 5, 5, 4, 2)]
    kind = pa.list_(pa.struct([("source", pa.string()), ("p", pa.int64()), ("p0", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "x", "x", "y", "x", "y"]), pa.array(lists, kind)], names=["lang", "x"])
    got = Counter()
    for out in divergence._corrections(iter([batch.slice(0, 2), batch.slice(2)])):
        for r in out.to_pylist():
            got[r["lang"], r["a"], r["b"]] += r["s"]
    f = lambda a, b: (a - b) ** 2 // (a + b)
    expected = Counter()
    for lang, of in zip(["x", "x", "x", "y", "x", "y"], lists, strict=True):
        for g in of:
            for h in of:
                if g is not h:
                    expected[lang, g["source"], h["source"]] += f(g["p"], h["p"]) - f(g["p"], h["p0"]) - f(g["p0"], h["p"]) + f(g["p0"], h["p0"])
    assert got == expected


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [("en", "a", "")], [("en", "a", "x y"), ("en", "b", None)]])
def test_tables_with_little(spark, rows):
    assert run(spark, rows, 10, 10, 1) == plain(rows, 10, 10)


def test_large_counts(spark):
    from pyspark.sql import functions as F

    a, b = 9 * 10**15 - 7, 9 * 10**15
    row = spark.createDataFrame([(a, b)], "a long, b long").select(divergence.share(F.col("a"), F.col("b")).alias("p")).first()
    assert row["p"] == 1 + 10**9 * a // b
