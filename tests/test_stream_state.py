from datetime import datetime, timedelta

from civicmesh.streaming import operators as streaming

START = datetime(2024, 1, 1)


def test_state_goes_with_the_watermark_and_late_events_are_dropped(spark, tmp_path):
    source, check = tmp_path / "in", tmp_path / "ck"
    got = {}

    def put(rows, name):
        df = spark.createDataFrame([(u, e, START + timedelta(seconds=s)) for u, e, s in rows], "user_id long, event_id long, ts timestamp")
        df.coalesce(1).write.parquet(str(source / name))

    def go():
        """The number of users with state after all that is there was read; the query begins anew from its checkpoint."""
        stream = spark.readStream.schema("user_id long, event_id long, ts timestamp").parquet(str(source / "*"))
        limited = streaming.rate_limited(stream, 2, 60, late="10 seconds")
        gather = lambda batch, _: got.update({(r.user_id, r.event_id): r.allowed for r in batch.collect()})
        q = limited.writeStream.foreachBatch(gather).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(check)).start()
        q.awaitTermination(60)
        assert q.exception() is None
        return q.lastProgress["stateOperators"][0]["numRowsTotal"]

    put([(1, 1, 0), (1, 2, 10), (1, 3, 20), (2, 4, 5)], "a")
    assert go() == 2 and got == {(1, 1): True, (1, 2): True, (1, 3): False, (2, 4): True}
    put([(1, 5, 30), (1, 6, 71)], "b")  # what passed at 0 and 10 was kept over the restart
    go()
    assert not got[1, 5] and got[1, 6]
    put([(3, 7, 1000)], "c")
    go()  # the watermark is at 990 once this batch is done: the others' state is over
    put([(3, 8, 1001), (1, 9, 100)], "d")  # the last one is late
    assert go() == 1 and (1, 9) not in got and got[3, 8]
