"""Edge joins, anti joins and grouped neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import in_box
from ..functions.text import normalized_title
from ..vocabulary import RESPONSE_TYPES


def responders(responds: DataFrame, drawn: DataFrame) -> DataFrame:
    """signal_id, tension_id, strength and edge of both kinds of response."""
    return responds.withColumn("edge", F.lit("responds_to")).unionByName(drawn.withColumn("edge", F.lit("drawn_to")))


def response_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("tension_id").agg(F.countDistinct("signal_id").alias("responses"))


def unresponded_tensions(signals: DataFrame, contains: DataFrame, edges: DataFrame, bounds: tuple, under: int = 2) -> DataFrame:
    """Live tensions in a box that are in no story and have under ``under`` responders."""
    rows = signals.where((F.col("node_type") == "Tension") & (F.col("review_status") == "live") & in_box(F.col("lat"), F.col("lng"), bounds))
    rows = rows.join(contains.select(F.col("signal_id").alias("id")).distinct(), "id", "left_anti")
    counted = rows.join(response_counts(edges).withColumnRenamed("tension_id", "id"), "id", "left").withColumn("responses", F.coalesce("responses", F.lit(0)))
    return counted.where(F.col("responses") < under)


def tension_hubs(signals: DataFrame, contains: DataFrame, edges: DataFrame, at_least: int = 2) -> DataFrame:
    """Tensions in no story with the number of their responders and the sum of these' ids."""
    tensions = signals.where("node_type = 'Tension'").join(contains.select(F.col("signal_id").alias("id")).distinct(), "id", "left_anti").select("id", "heat")
    known = signals.where(F.col("node_type").isin(*RESPONSE_TYPES)).select(F.col("id").alias("signal_id"))
    best = edges.groupBy("tension_id", "signal_id").agg(F.max("strength").alias("strength")).join(known, "signal_id")
    grouped = best.groupBy(F.col("tension_id").alias("id")).agg(F.count("*").alias("size"), F.sum("signal_id").alias("total"))
    return tensions.join(grouped.where(F.col("size") >= at_least), "id")


def story_growth(contains: DataFrame, signals: DataFrame, edges: DataFrame) -> DataFrame:
    """Responders of a story's tensions that the story does not have."""
    tensions = contains.join(signals.where("node_type = 'Tension'").select(F.col("id").alias("signal_id")), "signal_id").select("story_id", F.col("signal_id").alias("tension_id"))
    found = tensions.join(edges, "tension_id").select("story_id", "signal_id").distinct()
    return found.join(contains, ["story_id", "signal_id"], "left_anti")


def duplicate_actors(actors: DataFrame, acted: DataFrame) -> DataFrame:
    """Pairs of actors of one normalised name: the one with more edges is kept, then the smaller id."""
    name = F.regexp_replace(F.regexp_replace(normalized_title(F.col("name")), "[-#]", " "), r"\.", "")
    degree = acted.groupBy(F.col("actor_id").alias("id")).agg(F.count("*").alias("degree"))
    rows = actors.select("id", name.alias("key")).join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    # one winner for each name instead of all pairs of a name
    best = rows.groupBy("key").agg(F.max(F.struct("degree", -F.col("id"))).alias("w"), F.count("*").alias("n")).where("n > 1").select("key", (-F.col("w")["col2"]).alias("kept"))
    return rows.join(best, "key").where("id <> kept").select("kept", F.col("id").alias("merged"), "key")


def orphans(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    return nodes.join(edges.select(F.col(key).alias("id")).distinct(), "id", "left_anti")


def collected(edges: DataFrame, by: str, *columns: str) -> DataFrame:
    """Neighbours of each node as a sorted list, for batched readers."""
    return edges.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("items"))


def upserted(table: DataFrame, changes: DataFrame, keys: list[str], updated: list[str]) -> DataFrame:
    """``table`` with ``changes``: new keys get all columns, known ones only those in ``updated``; one change for each key."""
    c = changes.dropDuplicates(keys).withColumn("__new", F.lit(True))
    joined = table.withColumn("__old", F.lit(True)).alias("t").join(c.alias("c"), keys, "full")
    old = F.col("__old").isNotNull()

    def value(name: str) -> Column:
        if name in updated:
            return F.when(F.col("__new").isNotNull(), F.col(f"c.{name}")).otherwise(F.col(f"t.{name}")).alias(name)
        return F.when(old, F.col(f"t.{name}")).otherwise(F.col(f"c.{name}")).alias(name)

    return joined.select(*keys, *(value(n) for n in table.columns if n not in keys))


def staged(rows: DataFrame, dated: dict[str, list[str]]) -> DataFrame:
    """New signals: staged for review; columns that only some types have (``dated``: by type) are null in the others."""
    only = {c: kind for kind, columns in dated.items() for c in columns}
    value = lambda c: F.lit("staged") if c == "review_status" else F.when(F.col("node_type") == only[c], F.col(c)) if c in only else F.col(c)
    return rows.select(*(value(c).alias(c) for c in rows.columns))


def relinked(edges: DataFrame, again: DataFrame, key: str, cleared: DataFrame) -> DataFrame:
    """``edges`` without those of the ``cleared`` keys, and with the edges ``again``, each once."""
    return edges.join(cleared, key, "left_anti").unionByName(again).distinct()


def consumed(queue: DataFrame, used: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a queue that a run used, each once, and those that stay for the next one."""
    keys = used.select(key).distinct()
    return queue.join(keys, key, "left_semi"), queue.join(keys, key, "left_anti")
