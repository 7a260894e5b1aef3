import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from civicmesh.operators import dedup, graph, ordered, similar
from civicmesh.sources import archive, crawl
from civicmesh.streaming import operators as streaming


def plain_merge(order, pairs):
    near = {(a, b) for a, b in pairs} | {(b, a) for a, b in pairs}
    gone, out = set(), set()
    for i, a in enumerate(order):
        if a in gone:
            continue
        for b in order[i + 1 :]:
            if b not in gone and (a, b) in near:
                gone.add(b)
                out.add((a, b))
    return out


def test_greedy_merge_is_the_sequential_scan(spark):
    rng = random.Random(4)
    for n, m in ((12, 20), (40, 60), (6, 0)):
        order = list(range(n))
        rng.shuffle(order)
        pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
        p = spark.createDataFrame(list(pairs), "a long, b long")
        o = spark.createDataFrame([(x, i) for i, x in enumerate(order)], "id long, place long")
        assert {(r.survivor, r.absorbed) for r in similar.greedy_merge(p, o).collect()} == plain_merge(order, pairs)


def test_similar_pairs_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    x[7] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    n = np.linalg.norm(x.astype(np.float32).astype(float), axis=1)
    with np.errstate(invalid="ignore"):
        c = np.nan_to_num((x.astype(np.float32).astype(float) @ x.astype(np.float32).astype(float).T) / np.outer(n, n))
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if c[i, j] >= 0.5}
    assert {(r.a, r.b) for r in similar.similar_pairs(df, 0.5).collect()} == want
    monkeypatch.setattr(similar, "BLOCK", 16)
    assert {(r.a, r.b) for r in similar.similar_pairs(df, 0.5).collect()} == want
    some = {(r.a, r.b) for r in similar.similar_pairs(df.where("id < 10"), 0.5, df.where("id >= 10")).collect()}
    assert some == {(i, j) for i, j in want if i < 10 <= j}


def test_heat_of_lonely_and_empty(spark):
    schema = "id long, embedding array<float>, source_diversity long, channel_diversity long"
    assert similar.heat(spark.createDataFrame([], schema), 0.7).count() == 0
    rows = [(1, [1.0, 0.0], 1, 1), (2, [1.0, 0.1], 4, 1), (3, [0.0, 1.0], 1, 1)]
    got = {r.id: r.heat for r in similar.heat(spark.createDataFrame(rows, schema), 0.7).collect()}
    assert got[1] == 1.0 and 0 < got[2] < 1 and got[3] == 0.0


def test_verdict_thresholds(spark):
    rows = [("a", True, True, 1, 0.99, True), ("b", False, True, 1, 0.99, True), ("c", False, False, 1, 0.86, True), ("d", False, False, 1, 0.92, False), ("e", False, False, 1, 0.91, False), ("f", False, False, 1, 0.84, True), ("g", False, False, None, None, None)]
    df = spark.createDataFrame(rows, "k string, t1 boolean, t2 boolean, best long, cos double, same boolean")
    got = {r.k: r.v for r in df.select("k", dedup.verdicts("t1", "t2", "best", "cos", "same").alias("v")).collect()}
    assert got == {"a": "refresh", "b": "corroborate", "c": "refresh", "d": "corroborate", "e": "create", "f": "create", "g": "create"}


def plain_limit(times, limit, seconds):
    passed, out = [], []
    for t in times:
        ok = sum(p > t - timedelta(seconds=seconds) for p in passed) < limit
        passed += [t] * ok
        out.append(ok)
    return out


def test_rate_limit_batch_and_stream_agree(spark, tmp_path):
    rng = random.Random(2)
    start = datetime(2024, 1, 1)
    rows = [(u, i + 100 * u, t) for u in range(3) for i, t in enumerate(sorted(start + timedelta(seconds=rng.randint(0, 500)) for _ in range(30)))]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp")
    want = {(u, e): ok for u in range(3) for (e, ok) in zip([r[1] for r in rows if r[0] == u], plain_limit([r[2] for r in rows if r[0] == u], 2, 60), strict=True)}
    assert {(r.user_id, r.event_id): r.allowed for r in ordered.rate_limited(df, 2, 60).collect()} == want
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streaming.rate_limited(stream, 2, 60).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    assert {(r.user_id, r.event_id): r.allowed for r in spark.table("limited").collect()} == want


def test_ingest_appends_each_key_once(spark, tmp_path):
    target = str(tmp_path / "out")
    write = streaming.ingest(target, ["url", "hash"])
    a = spark.createDataFrame([("u", "1"), ("u", "1"), ("v", "2")], "url string, hash string")
    b = spark.createDataFrame([("u", "1"), ("u", "3")], "url string, hash string")
    write(a, 0)
    write(b, 1)
    write(b, 1)
    assert sorted((r.url, r.hash) for r in spark.read.parquet(target).collect()) == [("u", "1"), ("u", "3"), ("v", "2")]


def test_supervisor_window():
    now = datetime(2024, 1, 5)
    assert streaming.supervisor_window(None, now) == (datetime(2024, 1, 4), now)
    assert streaming.supervisor_window(datetime(2024, 1, 1), now) == (datetime(2024, 1, 1), datetime(2024, 1, 2))


def test_window_counts_stream_equals_batch(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, h, m), "a" if m % 2 else "b", 1.0) for h in range(4) for m in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "ts timestamp, kind string, value double")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    out = streaming.windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "kind", "value")
    q = out.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    batch = df.groupBy(F.window("ts", "1 hour").alias("w"), "kind").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "kind", "n", "total")
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, batch.collect()))


def test_upsert_and_duplicate_actors(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id long, name string, n long")
    new = spark.createDataFrame([(2, "x", 9), (3, "c", 1)], "id long, name string, n long")
    assert sorted(map(tuple, graph.upserted(old, new, ["id"], ["n"]).collect())) == [(1, "a", 5), (2, "b", 9), (3, "c", 1)]
    actors = spark.createDataFrame([(1, "St. Mary-House"), (2, "st mary house"), (3, "Other")], "id long, name string")
    acted = spark.createDataFrame([(2, 7), (2, 8), (1, 7)], "actor_id long, signal_id long")
    assert [tuple(r)[:2] for r in graph.duplicate_actors(actors, acted).collect()] == [(2, 1)]


def test_archive_and_crawl(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([("1", "s", "h", datetime(2024, 1, 1), "T"), ("2", "s", "g", datetime(2024, 1, 2), "U")], "id string, source_id string, content_hash string, fetched_at timestamp, title string")
    archive.append(rows, root, "pages")
    assert [r.id for r in archive.recent(spark, root, "pages").collect()] == ["2", "1"]
    assert [r.id for r in archive.by_source(spark, root, "pages", "s", 1).collect()] == ["2"]
    assert archive.unseen(rows, archive.read(spark, root, "pages")).count() == 0
    assert archive.freshness(spark, root, ("pages",)).first().last_scraped == datetime(2024, 1, 2)
    links = spark.createDataFrame([("http://a/1", "http://a/2"), ("http://a/2", "http://a/3"), ("http://a/3", "http://a/4#x"), ("http://a/2", "http://b/9"), ("http://a/2", "http://a/1")], "url string, target string")
    seeds = spark.createDataFrame([("http://a/1/",)], "url string")
    assert [(r.url, r.level) for r in crawl.crawl(seeds, links, 2, 10).collect()] == [("http://a/1", 0), ("http://a/2", 1), ("http://a/3", 2)]


def test_nearest_each_in_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 7)
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (60, 3)).astype(float)  # many ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    got = {(r.a, r.place): r.b for r in similar.nearest_each(df.where("id % 3 = 0"), df, 4, -0.5).collect()}
    norm = np.linalg.norm(x, axis=1)
    cos = np.round(np.divide(x @ x.T, np.outer(norm, norm), out=np.zeros((60, 60)), where=np.outer(norm, norm) > 0), 12)
    for i in range(0, 60, 3):
        want = sorted((j for j in range(60) if j != i and cos[i, j] >= -0.5), key=lambda j: -cos[i, j])[:4]
        assert sorted(np.round([cos[i, got[i, p]] for p in range(1, 1 + len(want))], 9)) == sorted(np.round([cos[i, j] for j in want], 9))


def test_layers_of_deduplication(spark):
    rows = [(1, "Aid", "s1", "Food shelf"), (2, "Aid", "s1", " food SHELF "), (3, "Aid", "s2", "food shelf"), (4, "Need", "s1", "food shelf"), (5, "Aid", "s1", "a"), (6, "Aid", "s3", "b"), (7, "Aid", "s3", "c")]
    signals = spark.createDataFrame(rows, "id long, node_type string, source string, title string")
    pairs = spark.createDataFrame([(1, 5, 0.86), (1, 6, 0.91), (1, 7, 0.93), (4, 7, 0.92), (2, 3, 0.99)], "a long, b long, cosine double")
    got = {r.id: r.verdict for r in dedup.layered_verdicts(signals, pairs).collect()}
    assert got == {1: "create", 2: "refresh", 3: "corroborate", 4: "create", 5: "refresh", 6: "create", 7: "corroborate"}


def test_staged_relinked_and_consumed(spark):
    rows = spark.createDataFrame([(1, "Aid", "live", 5), (2, "Gathering", None, 6)], "id long, node_type string, review_status string, starts_at long")
    assert sorted(map(tuple, graph.staged(rows, {"Gathering": ["starts_at"]}).collect())) == [(1, "Aid", "staged", None), (2, "Gathering", "staged", 6)]
    edges = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "story long, signal long")
    again = spark.createDataFrame([(1, 9), (1, 9)], "story long, signal long")
    assert sorted(map(tuple, graph.relinked(edges, again, "story", edges.select("story").where("story = 1").distinct()).collect())) == [(1, 9), (2, 3)]
    used, left = graph.consumed(edges, edges.where("signal > 1"), "signal")
    assert [r.signal for r in used.orderBy("signal").collect()] == [2, 3] and [r.signal for r in left.collect()] == [1]
