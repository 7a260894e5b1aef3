"""Site crawls over a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions.url import crawl_normalized, crawlable, same_host


def crawl(seeds: DataFrame, links: DataFrame, depth: int, limit: int, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """url and level of pages reached from ``seeds`` (url) over ``links`` (url, target) on the seed's host, breadth first.

    A level is one join and one anti join against what was visited. At most ``limit`` pages, the nearest first, then by url."""
    edges = links.select(crawl_normalized(F.col("url")).alias("url"), crawl_normalized(F.col("target")).alias("target"))
    edges = edges.where(same_host(F.col("url"), F.col("target")) & crawlable(F.col("target"), include or [], exclude or [])).distinct()
    front = checkpointed(seeds.select(crawl_normalized(F.col("url")).alias("url"), F.lit(0).alias("level")).distinct())
    seen = front
    for level in range(1, depth + 1):
        reached = edges.join(front.select("url"), "url").select(F.col("target").alias("url")).distinct()
        front = checkpointed(reached.join(seen.select("url"), "url", "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.orderBy("level", "url").limit(limit)
