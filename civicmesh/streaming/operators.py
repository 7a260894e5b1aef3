"""Incremental operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..checkpoints import new_folder


def supervisor_window(last_run: datetime | None, now: datetime, span: timedelta = timedelta(hours=24)) -> tuple[datetime, datetime]:
    """What a run examines: from the last one (a day ago without one) for a day at most; the next run begins at its end."""
    start = last_run or now - span
    return start, min(start + span, now)


def windowed_counts(events: DataFrame, ts: str, by: str, value: str, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of tumbling or sliding windows; rows later than ``late`` behind the newest are dropped."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def changed(pages: DataFrame, ts: str, url: str, digest: str, late: str = "1 hour") -> DataFrame:
    """The first of equal contents of a url; state goes with the watermark."""
    return pages.withWatermark(ts, late).dropDuplicatesWithinWatermark([url, digest])


def rate_limited(events: DataFrame, limit: int, seconds: int, late: str = "10 minutes") -> DataFrame:
    """user_id, event_id and allowed: fewer than ``limit`` events passed in the ``seconds`` before.

    The state of a user is the times that still count, ``limit`` at most; it is dropped once the watermark, ``late`` behind the newest
    event, has passed all of them. Events behind the watermark are dropped. Within a batch events pass in the order of time."""
    unit = 1_000_000

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        passed = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["micros", "event_id"])
        allowed = []
        for when in rows["micros"].astype("int64").tolist():
            passed = [p for p in passed if p > when - seconds * unit]
            ok = len(passed) < limit
            if ok:
                passed.append(when)
            allowed.append(ok)
        state.update((passed,))
        counts_until = (max(passed) + seconds * unit) // 1000 if passed else 0
        state.setTimeoutTimestamp(max(counts_until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "allowed": allowed})

    at = F.col("ts").cast("timestamp")
    rows = events.select("user_id", "event_id", at.alias("ts"), F.unix_micros(at).alias("micros")).withWatermark("ts", late)
    return rows.groupBy("user_id").applyInPandasWithState(fold, "user_id long, event_id long, allowed boolean", "passed array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def ingest(target: str, keys: list[str], verdict: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: rows of a batch whose keys the table at ``target`` lacks are appended, once for each batch number.

    ``verdict(batch, known)`` may decide instead which rows are new."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)  # the first batch finds no table
        known = spark.read.parquet(target).where(F.col("__batch") != number) if there else None
        rows = batch.dropDuplicates(keys)
        if known is not None:
            rows = verdict(rows, known) if verdict else rows.join(known.select(*keys).distinct(), keys, "left_anti")
        # a repeated batch overwrites its own partition
        rows.withColumn("__batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__batch").parquet(target)

    return write


def arrived(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """The files ``name`` of a folder (or those in a folder of that name) as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/{name}*")


def finished(stream: DataFrame) -> DataFrame:
    """What a streaming query in append mode gives for all that is there now, written to the shared folder with its checkpoint."""
    spark = stream.sparkSession
    out, check = new_folder(spark, "stream"), new_folder(spark, "stream-checkpoint")
    q = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(stream.schema).parquet(out)
