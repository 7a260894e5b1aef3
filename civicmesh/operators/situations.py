"""Temperature, arc and clarity of situations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as s
from ..functions import url as u
from .aggregates import entity_velocity


def temperatures(situations: DataFrame, evidences: DataFrame, signals: DataFrame, responds: DataFrame, now: Column) -> DataFrame:
    """id, temperature, arc and clarity: one grouping over a situation's signals, and one for the hosts that are new."""
    answered = responds.select(F.col("tension_id").alias("signal_id")).distinct().withColumn("answered", F.lit(True))
    rows = evidences.join(signals.withColumnRenamed("id", "signal_id"), "signal_id").join(answered, "signal_id", "left")
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("extracted_at").cast("timestamp"))
    tension, sound = F.col("node_type") == "Tension", ~F.col("debunked")
    recent = tension & (age <= 90 * 86400)
    thesis = tension & sound & (F.col("heat") >= 0.5)
    host = u.domain(F.col("source_url"))
    of = rows.groupBy("situation_id").agg(
        F.avg(F.when(tension & sound, F.col("heat"))).alias("tension_heat"),
        F.countDistinct(F.when(recent & F.col("answered").isNull(), F.col("signal_id"))).alias("unmet"),
        F.countDistinct(F.when(recent, F.col("signal_id"))).alias("total"),
        F.countDistinct(F.when(F.col("signal_id") % 2 == 0, host)).alias("external"),
        F.countDistinct(F.when(thesis, F.col("signal_id"))).alias("support"),
        F.countDistinct(F.when(thesis, host)).alias("diversity"),
    )
    velocity = entity_velocity(evidences, signals, now)
    out = situations.join(of, F.col("id") == F.col("situation_id"), "left").drop("situation_id").join(velocity, F.col("id") == F.col("situation_id"), "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    gap = F.when(n("total") > 0, n("unmet") / n("total")).otherwise(0.0)
    need = s.clarity_need(n("support"), n("diversity"), s.days_between(F.col("last_updated"), now))
    heat = s.temperature(n("tension_heat"), n("velocity"), gap, F.least(n("external") / 5.0, F.lit(1.0)), need)
    out = out.select("id", "first_seen", F.col("arc").alias("before"), heat.alias("temperature"), s.clarity(n("support"), n("diversity")).alias("clarity"))
    return out.withColumn("arc", s.situation_arc(F.col("temperature"), s.hours_between(F.col("first_seen"), now), F.col("before")))
