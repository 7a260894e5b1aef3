"""What to scrape next, and matching of resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as s
from .aggregates import every_nth


def scheduled(sources: DataFrame, now: Column, share: float = 0.1) -> DataFrame:
    """id and reason: sources that are due, and of the light ones that are stale for five days a tenth as many, the stalest first."""
    active = sources.where("active")
    waited = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_scraped").cast("timestamp"))
    due = F.col("last_scraped").isNull() | (waited > F.coalesce("cadence_hours", s.cadence_hours(F.col("weight"))) * 3600)
    reason = F.when(F.col("last_scraped").isNull(), "never").when(due, "cadence")
    rows = active.select("id", "weight", "last_scraped", waited.alias("waited"), reason.alias("reason"))
    n = max(1, int(rows.where("reason is not null").count() * share))
    explored = rows.where("reason is null and weight < 0.3 and waited >= 5 * 86400").orderBy("last_scraped", "id").limit(n)
    return rows.where("reason is not null").select("id", "reason").unionByName(explored.select("id", F.lit("exploration").alias("reason")))


def query_tiers(queries: DataFrame, hot: int, warm: int, per_tension: int = 3) -> DataFrame:
    """id and tier of queries (id, score, tension): the best, few of each tension, then an even sample of the rest."""
    order = [F.desc("score"), F.col("id")]
    within = F.row_number().over(Window.partitionBy("tension").orderBy(*order))
    first = queries.withColumn("within", within).where(F.col("within") <= per_tension).orderBy(*order).limit(hot).select("id")
    rest = queries.join(first, "id", "left_anti")
    return first.select("id", F.lit("hot").alias("tier")).unionByName(every_nth(rest, order, warm).select("id", F.lit("warm").alias("tier")))


def resource_match(edges: DataFrame, have: list[int]) -> DataFrame:
    """signal_id and score: share of what a signal requires that is at hand, and a fifth for each thing it prefers; over zero only."""
    hit = F.col("resource_id").isin(have)
    n = lambda c: F.count(F.when(c, 1))
    of = edges.groupBy("signal_id").agg(n(F.col("kind") == "requires").alias("req"), n((F.col("kind") == "requires") & hit).alias("mreq"), n((F.col("kind") == "prefers") & hit).alias("mpref"))
    share = F.when(F.col("req") > 0, F.col("mreq") / F.col("req")).otherwise(0.0)
    return of.where("mreq + mpref > 0").select("signal_id", (share + 0.2 * F.col("mpref")).alias("score"))
