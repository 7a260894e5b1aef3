import os

from pyspark.sql import functions as F

from civicmesh.operators import keyed


def files(path):
    return {os.path.join(root, n): os.stat(os.path.join(root, n)).st_mtime_ns for root, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def of_bucket(found):
    out = {}
    for path, at in found.items():
        out.setdefault(int(path.split("__bucket=")[1].split("/")[0]), set()).add((path, at))
    return out


def table(spark, tmp_path, rows, buckets=16):
    df = spark.createDataFrame(rows, "id long, v string")
    return keyed.KeyedTable(spark, str(tmp_path / "t"), ["id"], buckets).create(df)


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    t = table(spark, tmp_path, [(i, "old") for i in range(200)] + [(None, "old")])
    before = of_bucket(files(tmp_path / "t"))
    changes = spark.createDataFrame([(3, "new"), (500, "new"), (None, "new")], "id long, v string")
    touched = t.apply(changes)
    after = of_bucket(files(tmp_path / "t"))
    assert 1 <= len(touched) <= 3 and all(before[b] == after[b] for b in before if b not in touched)
    assert all(before.get(b) != after[b] for b in touched)
    want = {i: "old" for i in range(200)} | {3: "new", 500: "new", None: "new"}
    rows = t.read().collect()
    assert {r.id: r.v for r in rows} == want and len(rows) == len(want)


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    t = table(spark, tmp_path, [(1, "a"), (2, "b")])
    add = lambda old, new: old.unionByName(new)  # noqa: E731  would double rows if it ran twice
    changes = spark.createDataFrame([(2, "c"), (7, "d")], "id long, v string")
    assert t.apply(changes, add, 5) and t.done(5) and not t.done(6)
    before = files(tmp_path / "t")
    assert t.apply(changes, add, 5) == [] and files(tmp_path / "t") == before
    assert sorted((r.id, r.v) for r in t.read().collect()) == [(1, "a"), (2, "b"), (2, "c"), (7, "d")]
    assert t.apply(changes.limit(0), add, 6) == [] and t.done(6)


def test_a_row_that_merging_removes_leaves_its_partition(spark, tmp_path):
    t = table(spark, tmp_path, [(i, "x") for i in range(20)], 4)
    gone = lambda old, new: old.join(new.select("id"), "id", "left_anti")
    t.apply(spark.createDataFrame([(4, ""), (5, "")], "id long, v string"), gone)
    assert {r.id for r in t.read().collect()} == set(range(20)) - {4, 5}
    t.apply(spark.createDataFrame([(i, "") for i in range(20)], "id long, v string"), gone)
    assert t.read().count() == 0  # no partition keeps rows that are gone
    t.apply(spark.createDataFrame([(9, "again")], "id long, v string"))
    assert [tuple(r) for r in t.read().collect()] == [(9, "again")]


def test_a_stream_that_is_started_again(spark, tmp_path):
    t = table(spark, tmp_path, [(0, "a")], 8)
    source, check = tmp_path / "in", tmp_path / "ck"

    def put(rows, name):
        spark.createDataFrame(rows, "id long, v string").coalesce(1).write.parquet(str(source / name))

    def go():
        stream = spark.readStream.schema("id long, v string").parquet(str(source / "*"))
        latest = lambda batch: batch.groupBy("id").agg(F.max("v").alias("v"))
        q = stream.writeStream.foreachBatch(keyed.sink(t, latest)).trigger(availableNow=True).option("checkpointLocation", str(check)).start()
        q.awaitTermination(60)
        assert q.exception() is None

    put([(1, "b"), (1, "c"), (2, "d")], "one")
    go()
    put([(2, "e"), (3, "f")], "two")
    go()
    before = files(tmp_path / "t")
    go()  # nothing new
    assert files(tmp_path / "t") == before
    assert {r.id: r.v for r in t.read().collect()} == {0: "a", 1: "c", 2: "e", 3: "f"}
