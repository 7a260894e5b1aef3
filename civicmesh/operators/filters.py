"""Retrieval: boxes, expiry, sensitivity, rankings and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.scoring import unexpired
from ..vocabulary import CONFIDENCE_SHOWN
from .patterns import containing

Bounds = tuple[float, float, float, float]


def visible(now: Column) -> Column:
    """What may be shown: confident enough, placed, live and not expired."""
    fresh = unexpired(F.col("node_type"), F.col("starts_at"), F.col("ends_at"), F.col("is_recurring"), F.col("extracted_at"), F.col("confirmed_at"), now)
    return (F.col("confidence") >= CONFIDENCE_SHOWN) & (F.col("lat") != 0) & (F.col("review_status") == "live") & fresh


def inside(df: DataFrame, bounds: Bounds) -> DataFrame:
    return df.where(geo.in_box(F.col("lat"), F.col("lng"), bounds))


def fuzzed(df: DataFrame) -> DataFrame:
    """Coordinates as coarse as the sensitivity asks for, and their precision."""
    return df.withColumns({"lat": geo.snapped(F.col("lat"), F.col("sensitivity")), "lng": geo.snapped(F.col("lng"), F.col("sensitivity")), "precision": geo.precision(F.col("sensitivity"))})


def signals_in_bounds(signals: DataFrame, bounds: Bounds, now: Column, limit: int = 100) -> DataFrame:
    """Visible signals in a box by heat and confidence, at most ``limit`` (500 at most)."""
    rows = inside(signals.where(visible(now)), bounds).orderBy(F.desc("heat"), F.desc("confidence"), "id").limit(min(limit, 500))
    return fuzzed(rows)


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark limits each task's groups before the shuffle."""
    return df.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__place") <= n).drop("__place")


def signals_near(signals: DataFrame, stories: DataFrame, contains: DataFrame, lat: float, lng: float, radius_km: float, now: Column, per_type: int = 200) -> DataFrame:
    """Visible signals around a point: per type by the best type diversity of their stories, heat, confidence and confirmation."""
    best = contains.join(stories.select(F.col("id").alias("story_id"), "type_diversity"), "story_id").groupBy(F.col("signal_id").alias("id")).agg(F.max("type_diversity").alias("triangulation"))
    rows = inside(signals.where(visible(now)), geo.box(lat, lng, radius_km)).join(best, "id", "left").withColumn("triangulation", F.coalesce("triangulation", F.lit(0)))
    order = [F.desc("triangulation"), F.desc("heat"), F.desc("confidence"), F.desc("confirmed_at"), F.col("id")]
    return top_per(rows, ["node_type"], order, per_type)


def due_sources(sources: DataFrame, now: Column) -> DataFrame:
    """Active sources never scraped, or whose cadence (a day if none is set) is over."""
    waited = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_scraped").cast("timestamp"))
    return sources.where(F.col("active") & (F.col("last_scraped").isNull() | (waited > F.coalesce("cadence_hours", F.lit(24)) * 3600)))


def blocked(urls: DataFrame, patterns: DataFrame, url: str = "url", pattern: str = "pattern") -> DataFrame:
    """Urls that contain one of the patterns, of which there may be any number."""
    return containing(urls, patterns, url, pattern)
