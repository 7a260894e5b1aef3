"""The domain's tables as deterministic views of the driver's tables, as DataFrames and as DuckDB texts.

``AS_OF`` stands for now wherever an operator needs it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .vocabulary import SIGNAL_TYPES

AS_OF = "2024-05-01 00:00:00"
CENTRE = (44.98, -93.27)
LEVELS = ("low", "medium", "high", "critical")
METHODS = ("curated", "gap_analysis", "signal_expansion", "social_graph_follow", "linked_from", "hashtag_discovery")


def now() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def _days(start: str, days: Column) -> Column:
    return F.timestamp_add("DAY", days.cast("int"), F.lit(start).cast("timestamp_ntz"))


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    extracted = _days("2024-01-01 00:00:00", i % 120)
    starts = F.when((i % 5 == 0) & (i % 15 != 0), F.timestamp_add("DAY", (i % 60).cast("int"), extracted))
    return raw(spark, sf_dir, "documents").select(
        i.alias("id"),
        pick(SIGNAL_TYPES, i % 5).alias("node_type"),
        F.col("text").alias("title"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"), F.col("lang"), F.lit("/"), i.cast("string")).alias("source_url"),
        ((i * 37) % 100 / 100.0).alias("confidence"),
        (44.5 + (i * 7) % 100 / 100.0).alias("lat"),
        (-93.8 + (i * 13) % 100 / 100.0).alias("lng"),
        F.when(i % 10 == 0, "sensitive").when(i % 10 <= 2, "elevated").otherwise("general").alias("sensitivity"),
        extracted.alias("extracted_at"),
        F.timestamp_add("DAY", (i % 7).cast("int"), extracted).alias("confirmed_at"),
        starts.alias("starts_at"),
        F.when(i % 3 == 0, F.timestamp_add("HOUR", F.lit(2), starts)).alias("ends_at"),
        (i % 25 == 0).alias("is_recurring"),
        ((i * 17) % 100 / 100.0).alias("heat"),
        (1 + i % 4).alias("source_diversity"),
        (1 + i % 3).alias("channel_diversity"),
        (i % 6).alias("corroboration"),
        F.when(i % 11 == 0, "staged").when(i % 13 == 0, "rejected").otherwise("live").alias("review_status"),
        pick(LEVELS, i % 4).alias("severity"),
        F.col("source"),
        F.col("lang"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        (F.col("l_orderkey") % 1000).alias("signal_id"),
        F.concat(F.lit("https://s"), (F.col("l_suppkey") % 37).cast("string"), F.lit(".example.org/p/"), (F.col("l_partkey") % 50).cast("string")).alias("source_url"),
        (F.col("l_partkey") % 50).alias("content_hash"),
        F.col("l_shipdate").alias("retrieved_at"),
        pick(("press", "social", "direct_action", "community_media"), F.col("l_linenumber") % 4).alias("channel"),
        (F.col("l_discount") * 10).alias("confidence"),
    )


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("n_nationkey").cast("long")
    return raw(spark, sf_dir, "nation").select(
        i.alias("id"),
        F.col("n_name").alias("headline"),
        ((i * 29) % 100 / 100.0).alias("energy"),
        ((i * 31) % 100 / 50.0 - 1).alias("velocity"),
        F.when(i % 7 == 0, F.lit(None)).otherwise(pick(("emerging", "growing", "stable", "fading"), i % 4)).alias("arc"),
        F.when(i % 6 == 0, F.lit(None)).otherwise(pick(("resource", "crisis", "governance"), i % 3)).alias("category"),
        F.when(i % 9 == 0, "archived").otherwise("live").alias("status"),
        (1 + i % 5).alias("type_diversity"),
        (44.5 + (i * 7) % 100 / 100.0).alias("lat"),
        (-93.8 + (i * 13) % 100 / 100.0).alias("lng"),
        _days("2024-03-15 00:00:00", i % 45).alias("updated_at"),
    )


def contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return raw(spark, sf_dir, "documents").where("lang <> 'fr'").select((i % 25).alias("story_id"), i.alias("signal_id"))


def evidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return raw(spark, sf_dir, "documents").where("lang <> 'de'").select(i.alias("signal_id"), (i % 40).alias("situation_id"), (i % 17 == 0).alias("debunked"), (i % 100 / 100.0).alias("match_confidence"))


def situations(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey")
    return raw(spark, sf_dir, "part").select(
        i.alias("id"),
        F.col("p_name").alias("headline"),
        pick(("emerging", "developing", "active", "cooling", "cold"), i % 5).alias("arc"),
        ((i * 23) % 100 / 100.0).alias("temperature"),
        (44.5 + (i * 7) % 100 / 100.0).alias("lat"),
        (-93.8 + (i * 13) % 100 / 100.0).alias("lng"),
        _days("2024-01-01 00:00:00", i * 3).alias("first_seen"),
        _days("2024-02-01 00:00:00", i * 2).alias("last_updated"),
    )


def actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("c_custkey")
    name = F.regexp_replace(F.col("c_name"), "[0-9]+", (i % 97).cast("string"))
    return raw(spark, sf_dir, "customer").select(
        i.alias("id"),
        F.when(i % 2 == 0, F.upper(name)).otherwise(F.regexp_replace(name, "#", "-")).alias("name"),
        F.concat(F.lit("s"), (i % 37).cast("string"), F.lit(".example.org")).alias("domain"),
        (i % 4).alias("discovery_depth"),
        (44.5 + (i * 7) % 100 / 100.0).alias("lat"),
        (-93.8 + (i * 13) % 100 / 100.0).alias("lng"),
        _days("2024-01-01 00:00:00", i % 120).alias("last_active"),
    )


def acted_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw(spark, sf_dir, "orders").where("o_orderkey % 1000 >= 60 and o_custkey % 50 <> 7")  # some signals and actors stay alone
    return rows.select(F.col("o_custkey").alias("actor_id"), (F.col("o_orderkey") % 1000).alias("signal_id"), F.lower("o_orderstatus").alias("role")).distinct()


def _responder() -> Column:
    """A signal of a type that can answer: the first three of five. Some tensions have all their answers in one story."""
    anywhere = F.col("l_orderkey") % 200 * 5 + F.col("l_linenumber") % 3
    return F.when(F.col("l_partkey") % 20 == 1, F.col("l_orderkey") % 40 * 25 + 1).otherwise(anywhere)


#: Some tensions have no answer, and some signals answer none.
_ANSWERED = "l_partkey % 8 <> 0 and l_orderkey % 200 >= 10"


def responds_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aid, gathering or need to tension, with the strongest match of a pair."""
    rows = raw(spark, sf_dir, "lineitem").where(f"l_returnflag = 'R' and {_ANSWERED}").select(
        _responder().alias("signal_id"), (F.col("l_partkey") % 200 * 5 + 4).alias("tension_id"), (F.col("l_discount") * 10).alias("strength")
    )
    return rows.groupBy("signal_id", "tension_id").agg(F.max("strength").alias("strength"))


def drawn_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw(spark, sf_dir, "lineitem").where(f"l_returnflag = 'A' and {_ANSWERED}").select(
        _responder().alias("signal_id"), (F.col("l_partkey") % 200 * 5 + 4).alias("tension_id"), (F.col("l_discount") * 10).alias("strength")
    )
    return rows.groupBy("signal_id", "tension_id").agg(F.max("strength").alias("strength"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("s_suppkey")
    value = F.when(i % 4 == 0, F.concat(F.lit("mutual aid query "), (i % 9).cast("string"))).when(i % 4 == 1, F.concat(F.lit("https://www.instagram.com/group"), i.cast("string"), F.lit("/"))).otherwise(
        F.concat(F.lit("https://s"), (i % 37).cast("string"), F.lit(".example.org/"))
    )
    return raw(spark, sf_dir, "supplier").select(
        i.alias("id"),
        value.alias("value"),
        (i % 10 != 9).alias("active"),
        pick(METHODS, i % 6).alias("method"),
        (i % 10 / 10.0).alias("weight"),
        F.when(i % 5 == 0, F.lit(None).cast("int")).otherwise((i % 7 * 12).cast("int")).alias("cadence_hours"),
        F.when(i % 8 == 0, F.lit(None)).otherwise(_days("2024-04-20 00:00:00", i % 11)).alias("last_scraped"),
        (i % 13).alias("signals_produced"),
        (i % 5).alias("signals_corroborated"),
        (i % 9).alias("scrape_count"),
        (i % 12).alias("empty_runs"),
        pick(("response", "tension", "mixed"), i % 3).alias("role"),
        (1 - i % 3 / 10.0).alias("quality_penalty"),
        F.when(i % 3 == 0, F.concat(F.lit("found | Gap: gap_"), (i % 6).cast("string"), F.lit(" | heat="), (i % 10 / 10.0).cast("string"))).alias("gap_context"),
    )


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") * 1).cast("long").alias("signal_count"))


def needs_resource(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signal_id, resource_id and kind: requires, prefers or offers."""
    kind = F.when(F.col("l_returnflag") == "R", "requires").when(F.col("l_returnflag") == "A", "prefers").otherwise("offers")
    return raw(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1000).alias("signal_id"), (F.col("l_partkey") % 80).alias("resource_id"), kind.alias("kind")).distinct()


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "orders").select((F.col("o_orderkey") % 1000).alias("signal_id"), F.col("o_orderpriority").alias("tag")).distinct()


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    return raw(spark, sf_dir, "orders").select(
        i.alias("id"), (i % 1000).alias("target_id"), pick(("misclassified", "duplicate", "low_quality"), i % 3).alias("kind"), pick(("error", "warning"), i % 2).alias("severity"),
        F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "resolved").otherwise("dismissed").alias("status"), F.col("o_orderdate").alias("created_at"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "events").select((F.col("user_id") % 25).alias("story_id"), F.timestamp_add("DAY", F.lit(90), F.col("ts")).alias("taken_at"), F.col("event_id"), (F.col("event_id") % 40).alias("signal_count"), (F.col("event_id") % 9).alias("entity_count"))


def signal_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of the signals that have one."""
    return raw(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding"))


def pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-shot wishes to scrape a source at a place."""
    i = F.col("c_custkey")
    return raw(spark, sf_dir, "customer").where(i % 4 == 0).select(
        i.alias("id"), (i % 100).alias("source_id"), (44.5 + (i * 7) % 100 / 100.0).alias("lat"), (-93.8 + (i * 13) % 100 / 100.0).alias("lng"),
        _days("2024-03-01 00:00:00", i % 60).alias("created_at"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    return raw(spark, sf_dir, "orders").where(i % 8 == 0).select(
        i.alias("id"), (44.5 + (i * 7) % 100 / 100.0).alias("lat"), (-93.8 + (i * 13) % 100 / 100.0).alias("lng"), (i % 10 / 10.0).alias("priority"),
        pick(("pending", "running", "completed", "cancelled"), F.floor(i / 8) % 4).alias("status"), _days("2024-01-01 00:00:00", i % 117).alias("created_at"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey")
    kinds = ("image/png", "image/svg+xml", "video/mp4", "audio/ogg", "application/pdf", "text/html")
    return raw(spark, sf_dir, "part").select(
        i.alias("id"), F.concat(F.lit("https://files.example.org/"), i.cast("string")).alias("url"), pick(kinds, i % 6).alias("mime_type"),
        F.when(i % 7 == 0, "").when(i % 3 == 0, F.col("p_name")).alias("text"),
    )


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw(spark, sf_dir, "lineitem").where("l_orderkey % 5 = 0")
    return rows.select((F.col("l_orderkey") % 1000).alias("parent_id"), F.col("l_partkey").alias("file_id"), (F.col("l_linenumber") + F.col("l_orderkey")).alias("position"))


def dispatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return raw(spark, sf_dir, "events").where(i % 3 == 0).select(
        i.alias("id"), (i % 40).alias("situation_id"), F.timestamp_add("DAY", F.lit(90), F.col("ts")).alias("created_at"), (i % 11 == 0).alias("flagged"),
    )


def demands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What people searched for and where."""
    i = F.col("event_id")
    return raw(spark, sf_dir, "events").select(
        i.alias("id"), F.concat(F.col("event_type"), F.lit(" near "), (i % 12).cast("string")).alias("query"), F.timestamp_add("DAY", F.lit(92), F.col("ts")).alias("created_at"),
    )


def _sql_pick(values: tuple[str, ...], index: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST({index} AS INTEGER) + 1)"


_T = "TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 120 AS INTEGER))"
SQL: dict[str, str] = {
    "signals": f"""
        SELECT *, CASE WHEN id % 3 = 0 THEN starts_at + INTERVAL 2 HOUR END AS ends_at FROM (
        SELECT doc_id AS id, {_sql_pick(SIGNAL_TYPES, "doc_id % 5")} AS node_type, text AS title,
          'https://' || source || '.example.org/' || lang || '/' || doc_id AS source_url, ((doc_id * 37) % 100) / 100.0 AS confidence,
          44.5 + ((doc_id * 7) % 100) / 100.0 AS lat, -93.8 + ((doc_id * 13) % 100) / 100.0 AS lng,
          CASE WHEN doc_id % 10 = 0 THEN 'sensitive' WHEN doc_id % 10 <= 2 THEN 'elevated' ELSE 'general' END AS sensitivity,
          {_T} AS extracted_at, {_T} + to_days(CAST(doc_id % 7 AS INTEGER)) AS confirmed_at,
          CASE WHEN doc_id % 5 = 0 AND doc_id % 15 <> 0 THEN {_T} + to_days(CAST(doc_id % 60 AS INTEGER)) END AS starts_at,
          doc_id % 25 = 0 AS is_recurring, ((doc_id * 17) % 100) / 100.0 AS heat, 1 + doc_id % 4 AS source_diversity, 1 + doc_id % 3 AS channel_diversity,
          doc_id % 6 AS corroboration, CASE WHEN doc_id % 11 = 0 THEN 'staged' WHEN doc_id % 13 = 0 THEN 'rejected' ELSE 'live' END AS review_status,
          {_sql_pick(LEVELS, "doc_id % 4")} AS severity, source, lang FROM documents)""",
    "evidence": f"""
        SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey % 1000 AS signal_id, 'https://s' || (l_suppkey % 37) || '.example.org/p/' || (l_partkey % 50) AS source_url,
          l_partkey % 50 AS content_hash, l_shipdate AS retrieved_at, {_sql_pick(("press", "social", "direct_action", "community_media"), "l_linenumber % 4")} AS channel,
          l_discount * 10 AS confidence FROM lineitem""",
    "stories": f"""
        SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS headline, ((n_nationkey * 29) % 100) / 100.0 AS energy, ((n_nationkey * 31) % 100) / 50.0 - 1 AS velocity,
          CASE WHEN n_nationkey % 7 <> 0 THEN {_sql_pick(("emerging", "growing", "stable", "fading"), "n_nationkey % 4")} END AS arc,
          CASE WHEN n_nationkey % 6 <> 0 THEN {_sql_pick(("resource", "crisis", "governance"), "n_nationkey % 3")} END AS category,
          CASE WHEN n_nationkey % 9 = 0 THEN 'archived' ELSE 'live' END AS status, CAST(1 + n_nationkey % 5 AS BIGINT) AS type_diversity,
          44.5 + ((n_nationkey * 7) % 100) / 100.0 AS lat, -93.8 + ((n_nationkey * 13) % 100) / 100.0 AS lng,
          TIMESTAMP '2024-03-15 00:00:00' + to_days(CAST(n_nationkey % 45 AS INTEGER)) AS updated_at FROM nation""",
    "contains": "SELECT doc_id % 25 AS story_id, doc_id AS signal_id FROM documents WHERE lang <> 'fr'",
    "evidences": "SELECT doc_id AS signal_id, doc_id % 40 AS situation_id, doc_id % 17 = 0 AS debunked, (doc_id % 100) / 100.0 AS match_confidence FROM documents WHERE lang <> 'de'",
    "situations": f"""
        SELECT p_partkey AS id, p_name AS headline, {_sql_pick(("emerging", "developing", "active", "cooling", "cold"), "p_partkey % 5")} AS arc, ((p_partkey * 23) % 100) / 100.0 AS temperature,
          44.5 + ((p_partkey * 7) % 100) / 100.0 AS lat, -93.8 + ((p_partkey * 13) % 100) / 100.0 AS lng, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(p_partkey * 3 AS INTEGER)) AS first_seen,
          TIMESTAMP '2024-02-01 00:00:00' + to_days(CAST(p_partkey * 2 AS INTEGER)) AS last_updated FROM part""",
    "actors": """
        SELECT id, CASE WHEN id % 2 = 0 THEN upper(n) ELSE replace(n, '#', '-') END AS name, 's' || (id % 37) || '.example.org' AS domain, id % 4 AS discovery_depth,
          44.5 + ((id * 7) % 100) / 100.0 AS lat, -93.8 + ((id * 13) % 100) / 100.0 AS lng, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(id % 120 AS INTEGER)) AS last_active
        FROM (SELECT c_custkey AS id, regexp_replace(c_name, '[0-9]+', CAST(c_custkey % 97 AS VARCHAR), 'g') AS n FROM customer)""",
    "acted_in": "SELECT DISTINCT o_custkey AS actor_id, o_orderkey % 1000 AS signal_id, lower(o_orderstatus) AS role FROM orders WHERE o_orderkey % 1000 >= 60 AND o_custkey % 50 <> 7",
    "responds_to": """
        SELECT CASE WHEN l_partkey % 20 = 1 THEN l_orderkey % 40 * 25 + 1 ELSE l_orderkey % 200 * 5 + l_linenumber % 3 END AS signal_id,
          l_partkey % 200 * 5 + 4 AS tension_id, max(l_discount * 10) AS strength FROM lineitem
        WHERE l_returnflag = 'R' AND l_partkey % 8 <> 0 AND l_orderkey % 200 >= 10 GROUP BY 1, 2""",
    "drawn_to": """
        SELECT CASE WHEN l_partkey % 20 = 1 THEN l_orderkey % 40 * 25 + 1 ELSE l_orderkey % 200 * 5 + l_linenumber % 3 END AS signal_id,
          l_partkey % 200 * 5 + 4 AS tension_id, max(l_discount * 10) AS strength FROM lineitem
        WHERE l_returnflag = 'A' AND l_partkey % 8 <> 0 AND l_orderkey % 200 >= 10 GROUP BY 1, 2""",
    "sources": f"""
        SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'mutual aid query ' || (s_suppkey % 9) WHEN s_suppkey % 4 = 1 THEN 'https://www.instagram.com/group' || s_suppkey || '/'
          ELSE 'https://s' || (s_suppkey % 37) || '.example.org/' END AS value, s_suppkey % 10 <> 9 AS active, {_sql_pick(METHODS, "s_suppkey % 6")} AS method, (s_suppkey % 10) / 10.0 AS weight,
          CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey % 7 * 12 AS INTEGER) END AS cadence_hours,
          CASE WHEN s_suppkey % 8 <> 0 THEN TIMESTAMP '2024-04-20 00:00:00' + to_days(CAST(s_suppkey % 11 AS INTEGER)) END AS last_scraped,
          s_suppkey % 13 AS signals_produced, s_suppkey % 5 AS signals_corroborated, s_suppkey % 9 AS scrape_count, s_suppkey % 12 AS empty_runs,
          {_sql_pick(("response", "tension", "mixed"), "s_suppkey % 3")} AS role, 1 - (s_suppkey % 3) / 10.0 AS quality_penalty,
          CASE WHEN s_suppkey % 3 = 0 THEN 'found | Gap: gap_' || (s_suppkey % 6) || ' | heat=' || CAST((s_suppkey % 10) / 10.0 AS VARCHAR) END AS gap_context FROM supplier""",
    "resources": "SELECT p_partkey AS id, p_name AS name, CAST(p_size AS BIGINT) AS signal_count FROM part",
    "needs_resource": """
        SELECT DISTINCT l_orderkey % 1000 AS signal_id, l_partkey % 80 AS resource_id,
          CASE l_returnflag WHEN 'R' THEN 'requires' WHEN 'A' THEN 'prefers' ELSE 'offers' END AS kind FROM lineitem""",
    "tagged": "SELECT DISTINCT o_orderkey % 1000 AS signal_id, o_orderpriority AS tag FROM orders",
    "issues": f"""
        SELECT o_orderkey AS id, o_orderkey % 1000 AS target_id, {_sql_pick(("misclassified", "duplicate", "low_quality"), "o_orderkey % 3")} AS kind,
          {_sql_pick(("error", "warning"), "o_orderkey % 2")} AS severity, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'resolved' ELSE 'dismissed' END AS status, o_orderdate AS created_at FROM orders""",
    "snapshots": "SELECT user_id % 25 AS story_id, ts + INTERVAL 90 DAY AS taken_at, event_id, event_id % 40 AS signal_count, event_id % 9 AS entity_count FROM events",
    "signal_vectors": "SELECT vec_id AS id, embedding FROM embeddings",
    "pins": """
        SELECT c_custkey AS id, c_custkey % 100 AS source_id, 44.5 + ((c_custkey * 7) % 100) / 100.0 AS lat, -93.8 + ((c_custkey * 13) % 100) / 100.0 AS lng,
          TIMESTAMP '2024-03-01 00:00:00' + to_days(CAST(c_custkey % 60 AS INTEGER)) AS created_at FROM customer WHERE c_custkey % 4 = 0""",
    "tasks": f"""
        SELECT o_orderkey AS id, 44.5 + ((o_orderkey * 7) % 100) / 100.0 AS lat, -93.8 + ((o_orderkey * 13) % 100) / 100.0 AS lng, (o_orderkey % 10) / 10.0 AS priority,
          {_sql_pick(("pending", "running", "completed", "cancelled"), "(o_orderkey // 8) % 4")} AS status,
          TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(o_orderkey % 117 AS INTEGER)) AS created_at FROM orders WHERE o_orderkey % 8 = 0""",
    "files": f"""
        SELECT p_partkey AS id, 'https://files.example.org/' || p_partkey AS url,
          {_sql_pick(("image/png", "image/svg+xml", "video/mp4", "audio/ogg", "application/pdf", "text/html"), "p_partkey % 6")} AS mime_type,
          CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN p_name END AS text FROM part""",
    "attachments": "SELECT l_orderkey % 1000 AS parent_id, l_partkey AS file_id, l_linenumber + l_orderkey AS position FROM lineitem WHERE l_orderkey % 5 = 0",
    "dispatches": """
        SELECT event_id AS id, event_id % 40 AS situation_id, ts + INTERVAL 90 DAY AS created_at, event_id % 11 = 0 AS flagged FROM events WHERE event_id % 3 = 0""",
    "demands": "SELECT event_id AS id, event_type || ' near ' || (event_id % 12) AS query, ts + INTERVAL 92 DAY AS created_at FROM events",
}


def sql(body: str, *tables: str) -> str:
    """A DuckDB text with the named domain tables in front."""
    return "WITH " + ", ".join(f"{t} AS ({SQL[t]})" for t in tables) + "\n" + body  # a body may begin with a comma and further tables


NOW = f"TIMESTAMP '{AS_OF}'"


def r6(expr: str) -> str:
    """A double to six decimals, halves up, in DuckDB; ``rounded`` is the same in Spark."""
    return f"floor(({expr}) * 1e6 + 0.5) / 1e6"


def rounded(value: Column) -> Column:
    return F.floor(value * 1e6 + 0.5) / 1e6
