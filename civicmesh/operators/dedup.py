"""Ingestion verdicts and limits that depend on order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized_title


def title_verdicts(signals: DataFrame) -> DataFrame:
    """id and verdict: the first row of a title and type is created; later ones refresh it if their source is the same, else corroborate."""
    rows = signals.select("id", "node_type", "source", normalized_title(F.col("title")).alias("key"))
    first = rows.groupBy("node_type", "key").agg(F.min(F.struct("id", "source")).alias("first"))
    verdict = F.when(F.col("id") == F.col("first.id"), "create").when(F.col("source") == F.col("first.source"), "refresh").otherwise("corroborate")
    return rows.join(first, ["node_type", "key"]).select("id", verdict.alias("verdict"))


def layered_verdicts(signals: DataFrame, pairs: DataFrame, entry: float = 0.85, corroborates: float = 0.92) -> DataFrame:
    """id and verdict through all layers: equal title and type first, then the nearest earlier row of ``pairs`` (a < b, cosine)."""
    rows = signals.select("id", "node_type", "source", normalized_title(F.col("title")).alias("key"))
    first = rows.groupBy("node_type", "key").agg(F.min(F.struct("id", "source")).alias("first"))
    near = pairs.where(F.col("cosine") >= entry).groupBy(F.col("b").alias("id")).agg(F.max_by("a", F.struct("cosine", -F.col("a"))).alias("best"), F.max("cosine").alias("cosine"))
    near = near.join(rows.select(F.col("id").alias("best"), F.col("source").alias("best_source")), "best")
    full = rows.join(first, ["node_type", "key"]).join(near, "id", "left")
    titled = F.col("id") != F.col("first.id")
    full = full.withColumns({"again": titled & (F.col("source") == F.col("first.source")), "titled": titled, "same_url": F.coalesce(F.col("best_source") == F.col("source"), F.lit(False))})
    return full.select("id", verdicts("again", "titled", "best", "cosine", "same_url", entry, corroborates).alias("verdict"))


def verdicts(same_url_title: str, title: str, best: str, cosine: str, same_url: str, entry: float = 0.85, corroborates: float = 0.92):
    """create, refresh or corroborate from the layers' columns: a title match at the url, any title match, then the best similar row."""
    near = F.col(best).isNotNull() & (F.col(cosine) >= entry)
    return (
        F.when(F.col(same_url_title), "refresh")
        .when(F.col(title), "corroborate")
        .when(near & F.col(same_url), "refresh")
        .when(near & (F.col(cosine) >= corroborates), "corroborate")
        .otherwise("create")
    )
