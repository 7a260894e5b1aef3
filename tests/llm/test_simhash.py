import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from civicmesh.llm import simhash


def plain_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(rows):
    ids, prints = [r[0] for r in rows], [plain_fingerprint(r[1]) for r in rows]
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (f"{p:016x}", least[find(i)]) for i, (d, p) in enumerate(zip(ids, prints, strict=True))}


def texts():
    rng = np.random.default_rng(3)
    words = ["alpha", "Beta", "gámma", "delta", "eps", "zeta", "ETA", "théta", "iota", "kappa"]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(rng.choice(words, 300))))
    for i in range(60, 100):
        base = rows[i - 60][1].split(" ")
        base[int(rng.integers(len(base)))] = "changed"
        rows.append((i, "\n".join(base)))
    return rows + [(100, ""), (101, None), (102, " \t\n"), (103, "one two"), (104, "ONE\x0btwo"), (105, rows[3][1]), (106, rows[3][1]), (107, "x " * 5000)]


def test_equals_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("clash")).repartition(3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == plain_components(rows)
    kept = {r.doc_id for r in simhash.keep_first(df).collect()}
    assert kept == {d for d, (_, c) in got.items() if d == c}


def test_split_buckets_and_more_bands_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 40)
    prints = sorted({int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), False)) for c in centre for _ in range(20)})
    nodes = spark.createDataFrame([(i, simhash._signed(p)) for i, p in enumerate(prints)], "node long, fingerprint long")

    def classes():
        from civicmesh.llm.components import components

        return {r.node: r.component for r in components(simhash.links(nodes, split=8 if split else 16_384)).collect()}

    split = False
    whole = classes()
    split = True
    assert classes() == whole
    monkeypatch.setattr(simhash, "BUCKET", 0.01)
    assert simhash.bands_for(len(prints))[1] > 1
    assert classes() == whole
    brute = {(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4}
    assert all(whole[i] == whole[j] for i, j in brute)
    assert set(whole) == {i for pair in brute for i in pair}


def test_empty_table_and_missing_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c d e"), (None, None), (7, "a b c d e"), (7, "a b c d e")]
    got = sorted(map(str, (tuple(r)[::2] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert got == ["(7, 7)", "(7, 7)", "(None, 7)", "(None, None)"]
    kept = sorted(map(str, (tuple(r) for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert kept == ["(7, 'a b c d e')", "(None, None)"]


def test_a_row_without_doc_id_links_two_others(spark, monkeypatch):
    prints = {"left": 0, "middle": 0b1111, "right": 0b11111111, "far": (1 << 63) - 1}
    monkeypatch.setattr(simhash, "fingerprints", lambda df, *_: df.withColumn("fingerprint", F.create_map(*(F.lit(x) for kv in prints.items() for x in kv))[F.col("text")].cast("long")).drop("text"))
    rows = spark.createDataFrame([(9, "left"), (None, "middle"), (5, "right"), (7, "far")], "doc_id long, text string")
    for hot in (10_000, 0):  # 0: all fingerprints are broadcast
        monkeypatch.setattr(simhash, "HOT", hot)
        assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(rows).collect()} == {(9, 5), (None, 5), (5, 5), (7, 7)}
    assert {r.doc_id for r in simhash.keep_first(rows).collect()} == {5, 7}
