"""State changes as table rewrites, incremental operators and the remaining interface (J, K and N of the inventory)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import domain as d
from ..checkpoints import new_folder
from ..domain import NOW, r6, rounded, sql
from ..functions import scoring as s
from ..functions import text as x
from ..functions import url as u
from ..operators import dedup, filters, graph, keyed, ordered, similar
from ..streaming import operators as streaming
from .registry import Tables, query
from .retrieval import FRESH
from .vectors import cos

HOST = "split_part(source_url, '/', 3)"


@query("j02_evidence_upsert", sql("SELECT signal_id, source_url, coalesce(n.content_hash, o.content_hash) AS content_hash, o.signal_id IS NOT NULL AS known FROM (SELECT signal_id, source_url, max(content_hash) AS content_hash FROM evidence WHERE channel IN ('press', 'social') GROUP BY 1, 2) o FULL JOIN (SELECT signal_id, source_url, max(content_hash) + 1000 AS content_hash FROM evidence WHERE channel IN ('social', 'direct_action') GROUP BY 1, 2) n USING (signal_id, source_url)", "evidence"))
def j02(t: Tables):
    keys = ["signal_id", "source_url"]
    old = t.evidence.where("channel in ('press', 'social')").groupBy(*keys).agg(F.max("content_hash").alias("content_hash")).withColumn("known", F.lit(True))
    new = t.evidence.where("channel in ('social', 'direct_action')").groupBy(*keys).agg((F.max("content_hash") + 1000).alias("content_hash")).withColumn("known", F.lit(False))
    table = keyed.KeyedTable(t.spark, new_folder(t.spark, "evidence"), keys, 16).create(old)
    table.apply(new, lambda there, changes: graph.upserted(there, changes, keys, ["content_hash"]), number=0)
    return table.read()


@query("j03_refresh", sql(f"SELECT s.id, CAST(floor(epoch(greatest(s.confirmed_at, coalesce(e.at, s.confirmed_at)))) AS BIGINT) AS confirmed FROM signals s LEFT JOIN (SELECT signal_id, max(retrieved_at) AS at FROM evidence GROUP BY 1) e ON e.signal_id = s.id", "signals", "evidence"))
def j03(t: Tables):
    at = t.evidence.groupBy(F.col("signal_id").alias("id")).agg(F.max("retrieved_at").alias("at"))
    return t.signals.join(at, "id", "left").select("id", F.unix_seconds(F.greatest("confirmed_at", "at").cast("timestamp")).alias("confirmed"))


@query("j04_corroborate", sql("SELECT id, corroboration + coalesce(n, 0) AS corroboration FROM signals LEFT JOIN (SELECT signal_id, count(DISTINCT source_url) AS n FROM evidence WHERE channel = 'social' GROUP BY 1) ON signal_id = id", "signals", "evidence"))
def j04(t: Tables):
    n = t.evidence.where("channel = 'social'").groupBy(F.col("signal_id").alias("id")).agg(F.countDistinct("source_url").alias("n"))
    return t.signals.join(n, "id", "left").select("id", (F.col("corroboration") + F.coalesce("n", F.lit(0))).alias("corroboration"))


@query("j05_reap_expired", sql(f"SELECT node_type, count(*) FILTER (WHERE NOT ({FRESH})) AS reaped, count(*) FILTER (WHERE {FRESH}) AS kept FROM signals GROUP BY 1", "signals"))
def j05(t: Tables):
    fresh = s.unexpired(*(F.col(c) for c in ("node_type", "starts_at", "ends_at", "is_recurring", "extracted_at", "confirmed_at")), d.now())
    return t.signals.groupBy("node_type").agg(F.count(F.when(~fresh, 1)).alias("reaped"), F.count(F.when(fresh, 1)).alias("kept"))


@query("j06_delete_by_source", sql("SELECT id FROM signals WHERE source NOT IN ('src1', 'src7')", "signals"))
def j06(t: Tables):
    gone = t.spark.createDataFrame([("src1",), ("src7",)], "source string")
    return t.signals.join(gone, "source", "left_anti").select("id")


@query("j07_title_lookup", sql("SELECT b.id, min(a.id) AS existing FROM signals b JOIN signals a ON lower(trim(a.title)) = lower(trim(b.title)) AND a.node_type = b.node_type AND a.id < b.id WHERE b.node_type <> 'Tension' GROUP BY 1", "signals"))
def j07(t: Tables):
    rows = t.signals.where("node_type <> 'Tension'").select("id", "node_type", x.normalized_title(F.col("title")).alias("key"))
    first = rows.groupBy("node_type", "key").agg(F.min("id").alias("existing"))
    return rows.join(first, ["node_type", "key"]).where("id <> existing").select("id", "existing")


@query("j09_source_records", sql("SELECT id, signals_produced + id % 3 AS signals_produced, CASE WHEN id % 3 > 0 THEN 0 ELSE empty_runs + 1 END AS empty_runs, scrape_count + 1 AS scrape_count, active AND NOT (method <> 'curated' AND CASE WHEN id % 3 > 0 THEN 0 ELSE empty_runs + 1 END >= 10) AS active FROM sources", "sources"))
def j09(t: Tables):
    got = F.col("id") % 3
    empty = F.when(got > 0, F.lit(0)).otherwise(F.col("empty_runs") + 1)
    return t.sources.select("id", (F.col("signals_produced") + got).alias("signals_produced"), empty.alias("empty_runs"), (F.col("scrape_count") + 1).alias("scrape_count"), (F.col("active") & ~((F.col("method") != "curated") & (empty >= 10))).alias("active"))


@query("j10_actor_stats", sql("SELECT a.id, count(x.signal_id) AS signals, CAST(floor(epoch(max(greatest(a.last_active, coalesce(s.extracted_at, a.last_active))))) AS BIGINT) AS last_active FROM actors a LEFT JOIN acted_in x ON x.actor_id = a.id LEFT JOIN signals s ON s.id = x.signal_id GROUP BY 1", "actors", "acted_in", "signals"))
def j10(t: Tables):
    of = t.acted_in.join(t.signals.select(F.col("id").alias("signal_id"), "extracted_at"), "signal_id", "left").groupBy(F.col("actor_id").alias("id")).agg(F.count("signal_id").alias("signals"), F.max("extracted_at").alias("latest"))
    return t.actors.join(of, "id", "left").select("id", F.coalesce("signals", F.lit(0)).alias("signals"), F.unix_seconds(F.greatest("last_active", "latest").cast("timestamp")).alias("last_active"))


@query("j11_resource_counters", sql("SELECT slug, count(*) AS n FROM (SELECT array_to_string(list_filter(string_split(regexp_replace(lower(r.name), '[^a-z0-9]', ' ', 'g'), ' '), lambda w: w <> ''), '-') AS slug FROM needs_resource e JOIN resources r ON r.id = e.resource_id) GROUP BY 1", "needs_resource", "resources"))
def j11(t: Tables):
    rows = t.needs_resource.join(t.resources.select(F.col("id").alias("resource_id"), x.slug(F.col("name")).alias("slug")), "resource_id")
    return rows.groupBy("slug").agg(F.count("*").alias("n"))


@query("j12_edge_merge", sql("SELECT signal_id, tension_id, max(strength) AS strength FROM (SELECT * FROM responds_to UNION ALL SELECT * FROM drawn_to) GROUP BY 1, 2", "responds_to", "drawn_to"))
def j12(t: Tables):
    return t.responds_to.unionByName(t.drawn_to).groupBy("signal_id", "tension_id").agg(F.max("strength").alias("strength"))


@query("j13_tag_merge", sql("SELECT DISTINCT signal_id, CASE WHEN tag IN ('4-NOT SPECIFIED', '5-LOW') THEN '5-LOW' ELSE tag END AS tag FROM tagged", "tagged"))
def j13(t: Tables):
    return t.tagged.select("signal_id", F.when(F.col("tag") == "4-NOT SPECIFIED", "5-LOW").otherwise(F.col("tag")).alias("tag")).distinct()


@query("j15_review_gate", sql("SELECT id, CASE WHEN review_status <> 'staged' THEN review_status WHEN confidence >= 0.5 THEN 'live' ELSE 'rejected' END AS review_status FROM signals", "signals"))
def j15(t: Tables):
    status = F.col("review_status")
    return t.signals.select("id", F.when(status != "staged", status).when(F.col("confidence") >= 0.5, "live").otherwise("rejected").alias("review_status"))


@query("j16_new_issues", sql("SELECT DISTINCT id AS target_id FROM signals WHERE confidence < 0.2 AND id NOT IN (SELECT target_id FROM issues WHERE kind = 'low_quality' AND status = 'open')", "signals", "issues"))
def j16(t: Tables):
    there = t.issues.where("kind = 'low_quality' and status = 'open'").select("target_id")
    return t.signals.where("confidence < 0.2").select(F.col("id").alias("target_id")).join(there, "target_id", "left_anti").distinct()


@query("j17_task_transitions", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' AND epoch(TIMESTAMP '2001-08-01 00:00:00') - epoch(o_orderdate) > 1800 THEN 'pending' WHEN o_orderstatus = 'P' THEN 'running' ELSE 'done' END AS state FROM orders")
def j17(t: Tables):
    age = F.unix_seconds(F.lit("2001-08-01 00:00:00").cast("timestamp_ntz").cast("timestamp")) - F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    state = F.when((F.col("o_orderstatus") == "O") & (age > 1800), "pending").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    return t.orders.select(F.col("o_orderkey").alias("id"), state.alias("state"))


@query("j18_actor_merge", sql("SELECT count(*) AS edges, count(DISTINCT actor_id) AS actors FROM (SELECT DISTINCT coalesce(m.kept, x.actor_id) AS actor_id, signal_id, role FROM acted_in x LEFT JOIN (SELECT first_value(id) OVER w AS kept, id AS merged FROM (SELECT a.id, replace(replace(replace(lower(trim(name)), '-', ' '), '#', ' '), '.', '') AS key, coalesce(n, 0) AS n FROM actors a LEFT JOIN (SELECT actor_id, count(*) AS n FROM acted_in GROUP BY 1) d ON d.actor_id = a.id) WINDOW w AS (PARTITION BY key ORDER BY n DESC, id)) m ON m.merged = x.actor_id)", "actors", "acted_in"))
def j18(t: Tables):
    m = graph.duplicate_actors(t.actors, t.acted_in).select("kept", F.col("merged").alias("actor_id"))
    edges = t.acted_in.join(m, "actor_id", "left").select(F.coalesce("kept", "actor_id").alias("actor_id"), "signal_id", "role").distinct()
    return edges.agg(F.count("*").alias("edges"), F.countDistinct("actor_id").alias("actors"))


@query("j19_confidence_revision", sql(f"SELECT s.id, {r6('least(greatest(s.confidence + least(0.05 * count(*) FILTER (WHERE e.channel = $q$press$q$ AND e.confidence >= 0.7), 0.15) + least(0.02 * count(*) FILTER (WHERE e.channel = $q$social$q$ AND e.confidence >= 0.5), 0.06) - 0.10 * count(*) FILTER (WHERE e.channel = $q$direct_action$q$ AND e.confidence >= 0.9), 0.1), 1)').replace('$q$', chr(39))} AS confidence FROM signals s LEFT JOIN evidence e ON e.signal_id = s.id GROUP BY s.id, s.confidence", "signals", "evidence"))
def j19(t: Tables):
    n = lambda channel, least: F.count(F.when((F.col("channel") == channel) & (F.col("confidence") >= least), 1))
    of = t.evidence.groupBy(F.col("signal_id").alias("id")).agg(n("press", 0.7).alias("direct"), n("social", 0.5).alias("supporting"), n("direct_action", 0.9).alias("against"))
    step = s.confidence_step(*(F.coalesce(c, F.lit(0)) for c in ("direct", "supporting", "against")))
    return t.signals.join(of, "id", "left").select("id", rounded(s.clamp(F.col("confidence") + step, 0.1, 1.0)).alias("confidence"))


@query("j20_boost_sources", sql("SELECT id, CASE WHEN split_part(value, '/', 3) IN (SELECT split_part(source_url, '/', 3) FROM evidence JOIN evidences USING (signal_id) WHERE situation_id = 3) THEN least(weight * 1.5, 5.0) ELSE weight END AS weight FROM sources", "sources", "evidence", "evidences"))
def j20(t: Tables):
    hosts = t.evidence.join(t.evidences.where("situation_id = 3"), "signal_id", "left_semi").select(u.domain(F.col("source_url")).alias("host")).distinct().withColumn("hit", F.lit(True))
    rows = t.sources.withColumn("host", u.domain(F.col("value"))).join(hosts, "host", "left")
    return rows.select("id", F.when(F.col("hit"), F.least(F.col("weight") * 1.5, F.lit(5.0))).otherwise(F.col("weight")).alias("weight"))


@query("j21_curiosity", sql(f"SELECT id FROM situations WHERE arc IN ('emerging', 'developing') AND temperature >= 0.3 AND epoch({NOW}) - epoch(last_updated) >= 7 * 86400 ORDER BY temperature DESC, id LIMIT 5", "situations"))
def j21(t: Tables):
    age = F.unix_seconds(d.now().cast("timestamp")) - F.unix_seconds(F.col("last_updated").cast("timestamp"))
    return t.situations.where(F.col("arc").isin("emerging", "developing") & (F.col("temperature") >= 0.3) & (age >= 7 * 86400)).orderBy(F.desc("temperature"), "id").limit(5).select("id")


@query("k01_window_counts", "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS hour, event_type, count(*) AS n, floor(sum(value) * 1e4 + 0.5) / 1e4 AS total FROM events GROUP BY 1, 2")
def k01(t: Tables):
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return t.events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), (F.floor(F.sum("value") * 1e4 + 0.5) / 1e4).alias("total")).select(F.unix_seconds("w.start").alias("hour"), "event_type", "n", "total")


@query("k03_change_detection", sql("SELECT source_url, content_hash, count(*) - 1 AS refreshed FROM evidence GROUP BY 1, 2", "evidence"))
def k03(t: Tables):
    return t.evidence.groupBy("source_url", "content_hash").agg((F.count("*") - 1).alias("refreshed"))


@query(
    "k04_multi_layer_dedup",
    sql(
        f"""
        , f AS (SELECT id, source, min(id) OVER w AS first, first_value(source) OVER (PARTITION BY lower(trim(title)), node_type ORDER BY id) AS first_source
                FROM signals WINDOW w AS (PARTITION BY lower(trim(title)), node_type)),
        p AS (SELECT b.id, a.id AS other, {cos("a.embedding", "b.embedding")} AS c FROM signal_vectors a JOIN signal_vectors b ON a.id < b.id
              WHERE a.id IN (SELECT id FROM signals) AND b.id IN (SELECT id FROM signals)),
        n AS (SELECT id, arg_max(other, (c, -other)) AS best, max(c) AS c FROM p WHERE c >= 0.33 GROUP BY 1)
        SELECT f.id, CASE WHEN first <> f.id THEN CASE WHEN first_source = f.source THEN 'refresh' ELSE 'corroborate' END
                     WHEN o.source = f.source THEN 'refresh' WHEN n.c >= 0.38 THEN 'corroborate' ELSE 'create' END AS verdict
        FROM f LEFT JOIN n ON n.id = f.id LEFT JOIN signals o ON o.id = n.best
        """,
        "signals", "signal_vectors",
    ),
)
def k04(t: Tables):
    """Titles, then the nearest earlier vector; the bars are low, as the vectors of these tables are far apart."""
    vectors = t.signal_vectors.join(t.signals.select("id"), "id", "left_semi")
    return dedup.layered_verdicts(t.signals, similar.similar_pairs(vectors, 0.33), 0.33, 0.38)


@query("k05_trailing_counts", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS day FROM events")
def k05(t: Tables):
    at = F.unix_seconds(F.col("ts").cast("timestamp")).alias("at")
    return ordered.trailing_counts(t.events.select("user_id", "event_id", at), "user_id", "at", "event_id", 86400, "day").select("event_id", "day")


@query("k08_budget", "SELECT user_id, event_id, spent FROM (SELECT user_id, event_id, CAST(sum(event_id % 7) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS spent FROM events) WHERE spent <= 40")
def k08(t: Tables):
    return ordered.running(t.events.select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"], F.col("event_id") % 7, "spent").select("user_id", "event_id", "spent").where("spent <= 40")


RATE = """
    WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS micros, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    f AS (
        SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BOOLEAN) AS allowed, []::BIGINT[] AS passed FROM events
        UNION ALL
        SELECT user_id, i, event_id, len(kept) < 2, CASE WHEN len(kept) < 2 THEN list_append(kept, micros) ELSE kept END FROM (
            SELECT o.*, list_filter(f.passed, lambda p: p > o.micros - 21600000000) AS kept FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1))
    SELECT user_id, event_id, allowed FROM f WHERE event_id IS NOT NULL
"""


@query("e08_rate_limit", RATE)
def e08(t: Tables):
    return ordered.rate_limited(t.events.select("user_id", "event_id", "ts"), limit=2, seconds=6 * 3600)


@query("e08_rate_limit_stream", RATE)
def e08_stream(t: Tables):
    """The same through a stream: state by user, dropped with the watermark; all events are in one batch here, so none is late."""
    events = streaming.arrived(t.spark, t.sf_dir, "events.parquet", t.events.schema)
    return streaming.finished(streaming.rate_limited(events.select("user_id", "event_id", "ts"), limit=2, seconds=6 * 3600))


@query("l26_story_weaving", sql(f"SELECT CAST(sum(signals) AS BIGINT) AS signals, count(*) AS stories FROM (SELECT story_id, count(*) AS signals FROM (SELECT story_id, signal_id FROM contains UNION SELECT c.story_id, r.signal_id FROM contains c JOIN signals s ON s.id = c.signal_id AND node_type = 'Tension' JOIN responds_to r ON r.tension_id = c.signal_id) GROUP BY 1)", "contains", "signals", "responds_to"))
def l26(t: Tables):
    grown = graph.story_growth(t.contains, t.signals, t.responds_to)
    n = t.contains.unionByName(grown).groupBy("story_id").agg(F.count("*").alias("signals"))
    return n.agg(F.sum("signals").alias("signals"), F.count("*").alias("stories"))


@query("n04_effective_weight", sql("SELECT id, weight * quality_penalty AS weight, signals_produced FROM sources WHERE active ORDER BY 2 DESC, id LIMIT 100", "sources"))
def n04(t: Tables):
    return t.sources.where("active").select("id", (F.col("weight") * F.col("quality_penalty")).alias("weight"), "signals_produced").orderBy(F.desc("weight"), "id").limit(100)


@query("n08_nested_resolvers", sql("SELECT s.id, coalesce(e.n, 0) AS evidence, coalesce(a.n, 0) AS actors, coalesce(c.n, 0) AS stories, coalesce(x.n, 0) AS situations FROM signals s LEFT JOIN (SELECT signal_id, count(*) AS n FROM evidence GROUP BY 1) e ON e.signal_id = s.id LEFT JOIN (SELECT signal_id, count(*) AS n FROM acted_in GROUP BY 1) a ON a.signal_id = s.id LEFT JOIN (SELECT signal_id, count(*) AS n FROM contains GROUP BY 1) c ON c.signal_id = s.id LEFT JOIN (SELECT signal_id, count(*) AS n FROM evidences GROUP BY 1) x ON x.signal_id = s.id", "signals", "evidence", "acted_in", "contains", "evidences"))
def n08(t: Tables):
    out = t.signals.select("id")
    for name, edges in (("evidence", t.evidence), ("actors", t.acted_in), ("stories", t.contains), ("situations", t.evidences)):
        n = edges.groupBy(F.col("signal_id").alias("id")).agg(F.count("*").alias(name))
        out = out.join(n, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


@query("n11_active_queries", sql("SELECT id, value FROM sources WHERE active AND NOT regexp_matches(value, '^https?://')", "sources"))
def n11(t: Tables):
    return t.sources.where(F.col("active") & u.is_web_query(F.col("value"))).select("id", "value")


@query("n13_story_flags", sql("SELECT story_id, count(DISTINCT r.signal_id) >= 30 AS needs_refinement FROM contains c LEFT JOIN responds_to r ON r.tension_id = c.signal_id GROUP BY 1", "contains", "responds_to"))
def n13(t: Tables):
    r = t.responds_to.select(F.col("signal_id").alias("r"), F.col("tension_id").alias("signal_id"))
    return t.contains.join(r, "signal_id", "left").groupBy("story_id").agg((F.countDistinct("r") >= 30).alias("needs_refinement"))


@query("n17_cold_start", "SELECT r_name || ' ' || topic AS query FROM region CROSS JOIN (SELECT unnest(['food shelf', 'mutual aid', 'community meeting', 'volunteer']) AS topic)")
def n17(t: Tables):
    topics = F.explode(F.array(*map(F.lit, ("food shelf", "mutual aid", "community meeting", "volunteer"))))
    return t.region.select("r_name", topics.alias("topic")).select(F.concat_ws(" ", "r_name", "topic").alias("query"))
