"""Grouped computations over signals, stories and their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions import geo
from ..functions import url as u


def daily_volume(spark: SparkSession, rows: DataFrame, kind: str, kinds: list[str], first: str, last: str) -> DataFrame:
    """A row for each day from ``first`` to ``last`` with a count of each kind, zero where there is none."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    n = rows.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).groupBy("day").agg(*(F.count(F.when(F.col(kind) == k, 1)).alias(k.lower()) for k in kinds))
    return days.join(n, "day", "left").select(F.col("day").cast("string").alias("day"), *(F.coalesce(k.lower(), F.lit(0)).alias(k.lower()) for k in kinds))


def _with_hosts(signals: DataFrame, evidence: DataFrame, *more: str) -> DataFrame:
    """A row for each signal and host (and ``more``) of its evidence: distinct before the join, so that later counts need no distinct ones."""
    e = evidence.select("signal_id", u.domain(F.col("source_url")).alias("host"), *more)
    e = e.groupBy("signal_id", "host", *more).agg(F.count("*").alias("n"))
    return signals.select("id", u.domain(F.col("source_url")).alias("own")).join(e, F.col("id") == F.col("signal_id"), "left")


def source_diversity(signals: DataFrame, evidence: DataFrame) -> DataFrame:
    """Distinct hosts of each signal's evidence, one at least, and the share of pieces from other hosts than its own."""
    rows = _with_hosts(signals, evidence).groupBy("id")
    external = F.sum(F.when(F.col("host") != F.col("own"), F.col("n"))) / F.sum("n")
    return rows.agg(F.greatest(F.count("host"), F.lit(1)).alias("diversity"), F.coalesce(external, F.lit(0.0)).alias("external"))


def channel_diversity(signals: DataFrame, evidence: DataFrame) -> DataFrame:
    """Distinct channels with another host than the signal's own, one at least."""
    other = F.when(F.col("host") != F.col("own"), F.col("channel"))
    return _with_hosts(signals, evidence, "channel").groupBy("id").agg(F.greatest(F.countDistinct(other), F.lit(1)).alias("channels"))


def story_refresh(contains: DataFrame, signals: DataFrame) -> DataFrame:
    """All numbers that a story keeps about its members, from one grouping."""
    n = lambda kind: F.count(F.when(F.col("node_type") == kind, 1))
    rank = F.when(F.col("sensitivity") == "sensitive", 2).when(F.col("sensitivity") == "elevated", 1).otherwise(0)
    return contains.join(signals, F.col("signal_id") == F.col("id")).groupBy("story_id").agg(
        F.count("*").alias("signals"),
        F.countDistinct("node_type").alias("types"),
        F.avg(F.when(F.col("lat") != 0, F.col("lat"))).alias("lat"),
        F.avg(F.when(F.col("lng") != 0, F.col("lng"))).alias("lng"),
        F.max(rank).alias("sensitivity"),
        F.max("channel_diversity").alias("channels"),
        F.max(F.when(F.col("node_type") == "Tension", F.col("heat")).otherwise(0.0)).alias("heat"),
        n("Need").alias("asks"),
        n("Aid").alias("gives"),
        n("Gathering").alias("events"),
        (n("Need") - n("Aid")).alias("gap"),
    )


def snapshot_before(snapshots: DataFrame, now: Column) -> DataFrame:
    """The first snapshot of each story from eight to six days ago."""
    rows = snapshots.where(F.col("taken_at").between(now - F.expr("INTERVAL 8 DAY"), now - F.expr("INTERVAL 6 DAY")))
    at = F.struct("taken_at", "event_id")
    return rows.groupBy("story_id").agg(F.min_by("signal_count", at).alias("signal_count"), F.min_by("entity_count", at).alias("entity_count"))


def resource_gaps(resources: DataFrame, edges: DataFrame) -> DataFrame:
    n = edges.groupBy(F.col("resource_id").alias("id")).agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(c) for k, c in (("requires", "required"), ("offers", "offered"))))
    out = resources.select("id").join(n, "id", "left").select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("required", "offered")))
    return out.withColumn("gap", F.col("required") - F.col("offered"))


def beacons(signals: DataFrame, at_least: int, full: float) -> DataFrame:
    rows = signals.groupBy(geo.geohash(F.col("lat"), F.col("lng")).alias("cell"))
    return rows.agg(F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.least(F.count("*") / full, F.lit(1.0)).alias("priority")).where(F.col("n") >= at_least)


def counted(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def every_nth(df: DataFrame, order: list[Column], budget: int) -> DataFrame:
    """A systematic sample of about ``budget`` rows: every nth in order, from the first.

    Rows are ranked inside range partitions; only the partitions' sizes meet in one place."""
    rows = checkpointed(df.sort(*order).withColumn("__part", F.spark_partition_id()))
    rows = rows.withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = sizes.agg(F.sum("__n").alias("__total"))
    step = F.ceil(F.col("__total") / float(budget))
    # both sides of these joins have a row for each partition at most
    placed = rows.join(F.broadcast(before.select("__part", "__before")), "__part").join(F.broadcast(total))
    return placed.where((F.col("__before") + F.col("__in") - 1) % step == 0).drop("__part", "__in", "__before", "__total")


def entity_velocity(evidences: DataFrame, signals: DataFrame, now: Column) -> DataFrame:
    """Hosts of a situation first seen in a week (of three) or a month (of five), the larger share, one at most."""
    at = F.unix_seconds(F.col("extracted_at").cast("timestamp"))
    hosts = evidences.join(signals, F.col("signal_id") == F.col("id")).groupBy("situation_id", u.domain(F.col("source_url")).alias("host")).agg((F.unix_seconds(now.cast("timestamp")) - F.min(at)).alias("age"))
    n = lambda days: F.count(F.when(F.col("age") <= days * 86400, 1))
    return hosts.groupBy("situation_id").agg(F.least(F.greatest(n(7) / 3.0, n(30) / 5.0), F.lit(1.0)).alias("velocity"))
