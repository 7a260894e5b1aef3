"""Aggregations and windows (D and E of the inventory)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import domain as d
from ..domain import NOW, r6, rounded, sql
from ..functions import geo
from ..functions import scoring as s
from ..functions import text as x
from ..functions import url as u
from ..operators import aggregates as agg
from ..operators import map_clusters
from .registry import Tables, query
from .retrieval import EDGES

SPINE = f"(SELECT CAST(day AS DATE) AS day FROM range(DATE '2024-04-02', DATE '2024-05-02', INTERVAL 1 DAY) r(day))"
HOST = "lower(split_part(split_part(e.source_url, '://', 2), '/', 1))"
OWN = "lower(split_part(split_part(s.source_url, '://', 2), '/', 1))"


@query("d01_count_by_type", sql("SELECT node_type, count(*) AS n FROM signals GROUP BY 1", "signals"))
def d01(t: Tables):
    return t.signals.groupBy("node_type").agg(F.count("*").alias("n"))


@query("d02_confidence_histogram", sql("SELECT CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'good' WHEN confidence >= 0.4 THEN 'fair' ELSE 'low' END AS bucket, count(*) AS n FROM signals GROUP BY 1", "signals"))
def d02(t: Tables):
    c = F.col("confidence")
    return t.signals.groupBy(F.when(c >= 0.8, "high").when(c >= 0.6, "good").when(c >= 0.4, "fair").otherwise("low").alias("bucket")).agg(F.count("*").alias("n"))


@query("d03_freshness_histogram", sql(f"SELECT CASE WHEN a <= 7 THEN 'week' WHEN a <= 30 THEN 'month' WHEN a <= 90 THEN 'quarter' ELSE 'older' END AS bucket, count(*) AS n FROM (SELECT floor((epoch({NOW}) - epoch(confirmed_at)) / 86400) AS a FROM signals) GROUP BY 1", "signals"))
def d03(t: Tables):
    a = s.days_between(F.col("confirmed_at"), d.now())
    return t.signals.groupBy(F.when(a <= 7, "week").when(a <= 30, "month").when(a <= 90, "quarter").otherwise("older").alias("bucket")).agg(F.count("*").alias("n"))


@query("d04_daily_volume", sql("SELECT CAST(p.day AS VARCHAR) AS day, " + ", ".join(f"count(*) FILTER (WHERE node_type = '{n}') AS {n.lower()}" for n in d.SIGNAL_TYPES) + f" FROM {SPINE} p LEFT JOIN signals s ON CAST(s.extracted_at AS DATE) = p.day GROUP BY 1", "signals"))
def d04(t: Tables):
    return agg.daily_volume(t.spark, t.signals.select(F.to_date("extracted_at").alias("day"), "node_type"), "node_type", list(d.SIGNAL_TYPES), "2024-04-02", "2024-05-01")


@query("d05_archive_volume", "SELECT CAST(p.day AS VARCHAR) AS day, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{n}') AS {n}" for n in ("click", "error", "purchase", "signup", "view")) + " FROM (SELECT CAST(day AS DATE) AS day FROM range(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY) r(day)) p LEFT JOIN events e ON CAST(e.ts AS DATE) = p.day GROUP BY 1")
def d05(t: Tables):
    return agg.daily_volume(t.spark, t.events.select(F.to_date("ts").alias("day"), "event_type"), "event_type", ["click", "error", "purchase", "signup", "view"], "2024-01-01", "2024-01-30")


@query("d06_archive_counts", "SELECT 'pages' AS kind, count(*) AS n FROM pages UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'events', count(*) FROM events")
def d06(t: Tables):
    out = None
    for name in ("pages", "documents", "conversations", "events"):
        one = getattr(t, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("d07_stories_by_arc", sql("SELECT coalesce(arc, 'unknown') AS arc, coalesce(category, 'uncategorized') AS category, count(*) AS n FROM stories GROUP BY 1, 2", "stories"))
def d07(t: Tables):
    return t.stories.groupBy(F.coalesce("arc", F.lit("unknown")).alias("arc"), F.coalesce("category", F.lit("uncategorized")).alias("category")).agg(F.count("*").alias("n"))


@query("d08_story_evidence_count", sql("SELECT story_id, count(DISTINCT e.id) AS pieces FROM contains JOIN evidence e USING (signal_id) GROUP BY 1", "contains", "evidence"))
def d08(t: Tables):
    return t.contains.join(t.evidence, "signal_id").groupBy("story_id").agg(F.countDistinct("id").alias("pieces"))


@query("d09_source_diversity", sql(f"SELECT s.id, greatest(count(DISTINCT {HOST}), 1) AS diversity, {r6(f'coalesce(avg(CASE WHEN e.id IS NULL THEN NULL WHEN {HOST} <> {OWN} THEN 1.0 ELSE 0.0 END), 0)')} AS external FROM signals s LEFT JOIN evidence e ON e.signal_id = s.id GROUP BY 1", "signals", "evidence"))
def d09(t: Tables):
    return agg.source_diversity(t.signals, t.evidence).select("id", "diversity", rounded(F.col("external")).alias("external"))


@query("d10_channel_diversity", sql(f"SELECT s.id, greatest(count(DISTINCT CASE WHEN {HOST} <> {OWN} THEN e.channel END), 1) AS channels FROM signals s LEFT JOIN evidence e ON e.signal_id = s.id GROUP BY 1", "signals", "evidence"))
def d10(t: Tables):
    return agg.channel_diversity(t.signals, t.evidence)


@query("d11_type_diversity", sql("SELECT story_id, count(DISTINCT node_type) AS types FROM contains JOIN signals ON id = signal_id GROUP BY 1", "contains", "signals"))
def d11(t: Tables):
    return t.contains.join(t.signals, F.col("signal_id") == F.col("id")).groupBy("story_id").agg(F.countDistinct("node_type").alias("types"))


@query(
    "d12_story_refresh",
    sql(f"""SELECT story_id, count(*) AS signals, count(DISTINCT node_type) AS types, {r6("avg(CASE WHEN lat <> 0 THEN lat END)")} AS lat, {r6("avg(CASE WHEN lng <> 0 THEN lng END)")} AS lng,
        max(CASE sensitivity WHEN 'sensitive' THEN 2 WHEN 'elevated' THEN 1 ELSE 0 END) AS sensitivity, max(channel_diversity) AS channels, max(CASE WHEN node_type = 'Tension' THEN heat ELSE 0 END) AS heat,
        count(*) FILTER (WHERE node_type = 'Need') AS asks, count(*) FILTER (WHERE node_type = 'Aid') AS gives, count(*) FILTER (WHERE node_type = 'Gathering') AS events,
        count(*) FILTER (WHERE node_type = 'Need') - count(*) FILTER (WHERE node_type = 'Aid') AS gap FROM contains JOIN signals ON id = signal_id GROUP BY 1""", "contains", "signals"),
)
def d12(t: Tables):
    out = agg.story_refresh(t.contains, t.signals)
    return out.withColumns({"lat": rounded(F.col("lat")), "lng": rounded(F.col("lng"))})


@query("d13_source_stats", sql("SELECT count(*) AS total, count(*) FILTER (WHERE active) AS active, count(*) FILTER (WHERE method = 'curated') AS curated, count(*) FILTER (WHERE method <> 'curated') AS discovered FROM sources", "sources"))
def d13(t: Tables):
    n = lambda c: F.count(F.when(c, 1))
    return t.sources.agg(F.count("*").alias("total"), n(F.col("active")).alias("active"), n(F.col("method") == "curated").alias("curated"), n(F.col("method") != "curated").alias("discovered"))


@query("d14_recent_types", sql(f"SELECT node_type, count(*) AS n FROM signals WHERE epoch({NOW}) - epoch(extracted_at) <= 30 * 86400 GROUP BY 1", "signals"))
def d14(t: Tables):
    age = F.unix_seconds(d.now().cast("timestamp")) - F.unix_seconds(F.col("extracted_at").cast("timestamp"))
    return t.signals.where(age <= 30 * 86400).groupBy("node_type").agg(F.count("*").alias("n"))


@query("d15_gap_types", sql(f"SELECT trim(regexp_extract(gap_context, '\\| Gap: ([^|]*)\\|', 1)) AS gap, count(*) AS total, count(*) FILTER (WHERE signals_produced > 0) AS successes, {r6('avg(weight)')} AS weight FROM sources WHERE regexp_extract(gap_context, '\\| Gap: ([^|]*)\\|', 1) <> '' GROUP BY 1", "sources"))
def d15(t: Tables):
    g = t.sources.withColumn("gap", x.gap_type(F.col("gap_context"))).where("gap is not null")
    return g.groupBy("gap").agg(F.count("*").alias("total"), F.count(F.when(F.col("signals_produced") > 0, 1)).alias("successes"), rounded(F.avg("weight")).alias("weight"))


@query("d16_extraction_yield", sql("SELECT source, count(*) AS extracted, count(*) FILTER (WHERE review_status = 'live') AS survived, count(*) FILTER (WHERE corroboration > 0) AS corroborated, count(*) FILTER (WHERE i.target_id IS NOT NULL) AS contradicted FROM signals s LEFT JOIN (SELECT DISTINCT target_id FROM issues WHERE kind = 'misclassified') i ON i.target_id = s.id GROUP BY 1", "signals", "issues"))
def d16(t: Tables):
    bad = t.issues.where("kind = 'misclassified'").select(F.col("target_id").alias("id"), F.lit(1).alias("bad")).distinct()
    n = lambda c: F.count(F.when(c, 1))
    return t.signals.join(bad, "id", "left").groupBy("source").agg(F.count("*").alias("extracted"), n(F.col("review_status") == "live").alias("survived"), n(F.col("corroboration") > 0).alias("corroborated"), F.count("bad").alias("contradicted"))


@query("d17_snapshot_lookback", sql(f"SELECT story_id, arg_min(signal_count, (taken_at, event_id)) AS signal_count, arg_min(entity_count, (taken_at, event_id)) AS entity_count FROM snapshots WHERE taken_at BETWEEN {NOW} - INTERVAL 8 DAY AND {NOW} - INTERVAL 6 DAY GROUP BY 1", "snapshots"))
def d17(t: Tables):
    return agg.snapshot_before(t.snapshots, d.now())


@query("d18_resource_gaps", sql("SELECT r.id, coalesce(q.n, 0) AS required, coalesce(o.n, 0) AS offered, coalesce(q.n, 0) - coalesce(o.n, 0) AS gap FROM resources r LEFT JOIN (SELECT resource_id, count(*) AS n FROM needs_resource WHERE kind = 'requires' GROUP BY 1) q ON q.resource_id = r.id LEFT JOIN (SELECT resource_id, count(*) AS n FROM needs_resource WHERE kind = 'offers' GROUP BY 1) o ON o.resource_id = r.id", "resources", "needs_resource"))
def d18(t: Tables):
    return agg.resource_gaps(t.resources, t.needs_resource)


@query("d19_story_tags", sql("SELECT story_id, tag, count(*) AS n FROM contains JOIN tagged USING (signal_id) GROUP BY 1, 2 HAVING count(*) >= 2", "contains", "tagged"))
def d19(t: Tables):
    return t.contains.join(t.tagged, "signal_id").groupBy("story_id", "tag").agg(F.count("*").alias("n")).where("n >= 2")


@query("d20_top_tags", sql("SELECT tag, count(DISTINCT story_id) AS stories FROM contains JOIN tagged USING (signal_id) GROUP BY 1 ORDER BY stories DESC, tag LIMIT 10", "contains", "tagged"))
def d20(t: Tables):
    return t.contains.join(t.tagged, "signal_id").groupBy("tag").agg(F.countDistinct("story_id").alias("stories")).orderBy(F.desc("stories"), "tag").limit(10)


@query("d21_actor_roles", sql("SELECT a.id, CASE WHEN r > x THEN 'response' WHEN x > r THEN 'tension' ELSE 'mixed' END AS role FROM (SELECT id FROM actors WHERE discovery_depth < 3) a JOIN (SELECT actor_id, count(*) FILTER (WHERE node_type IN ('Gathering', 'Aid', 'Need')) AS r, count(*) FILTER (WHERE node_type = 'Tension') AS x FROM acted_in JOIN signals ON id = signal_id GROUP BY 1) c ON c.actor_id = a.id", "actors", "acted_in", "signals"))
def d21(t: Tables):
    n = lambda c: F.count(F.when(c, 1))
    c = t.acted_in.join(t.signals.select(F.col("id").alias("signal_id"), "node_type"), "signal_id").groupBy(F.col("actor_id").alias("id"))
    c = c.agg(n(F.col("node_type").isin("Gathering", "Aid", "Need")).alias("r"), n(F.col("node_type") == "Tension").alias("x"))
    return t.actors.where("discovery_depth < 3").join(c, "id").select("id", F.when(F.col("r") > F.col("x"), "response").when(F.col("x") > F.col("r"), "tension").otherwise("mixed").alias("role"))


@query("d22_unmet_tensions", sql("SELECT s.id, count(r.signal_id) AS responses, count(r.signal_id) = 0 AS unmet FROM signals s LEFT JOIN responds_to r ON r.tension_id = s.id WHERE node_type = 'Tension' GROUP BY 1, corroboration, source_diversity, heat, severity ORDER BY responses, corroboration + source_diversity DESC, heat DESC, severity DESC, s.id LIMIT 50", "signals", "responds_to"))
def d22(t: Tables):
    n = t.responds_to.groupBy(F.col("tension_id").alias("id")).agg(F.count("*").alias("responses"))
    rows = t.signals.where("node_type = 'Tension'").join(n, "id", "left").withColumn("responses", F.coalesce("responses", F.lit(0)))
    rows = rows.orderBy("responses", F.desc(F.col("corroboration") + F.col("source_diversity")), F.desc("heat"), F.desc("severity"), "id").limit(50)
    return rows.select("id", "responses", (F.col("responses") == 0).alias("unmet"))


@query("d23_discovery_performance", sql("SELECT id, 'winner' AS kind FROM (SELECT id FROM sources WHERE method <> 'curated' AND signals_produced > 0 ORDER BY signals_produced DESC, weight DESC, id LIMIT 5) UNION ALL SELECT id, 'failure' FROM (SELECT id FROM sources WHERE method <> 'curated' AND signals_produced = 0 ORDER BY empty_runs DESC, id LIMIT 5)", "sources"))
def d23(t: Tables):
    found = t.sources.where("method <> 'curated'")
    best = found.where("signals_produced > 0").orderBy(F.desc("signals_produced"), F.desc("weight"), "id").limit(5).select("id", F.lit("winner").alias("kind"))
    return best.unionByName(found.where("signals_produced = 0").orderBy(F.desc("empty_runs"), "id").limit(5).select("id", F.lit("failure").alias("kind")))


@query("d24_issue_summary", sql("SELECT kind, severity, count(*) FILTER (WHERE status = 'open') AS open, count(*) FILTER (WHERE status = 'resolved') AS resolved, count(*) FILTER (WHERE status = 'dismissed') AS dismissed FROM issues GROUP BY 1, 2", "issues"))
def d24(t: Tables):
    return t.issues.groupBy("kind", "severity").agg(*(F.count(F.when(F.col("status") == v, 1)).alias(v) for v in ("open", "resolved", "dismissed")))


@query("d25_demand_grid", sql(f"SELECT CAST(round(lat / 0.05) AS BIGINT) AS y, CAST(round(lng / 0.05) AS BIGINT) AS x, count(*) AS n, {r6('avg(lat)')} AS lat, {r6('avg(lng)')} AS lng FROM signals WHERE node_type = 'Need' GROUP BY 1, 2 HAVING count(*) >= 2", "signals"))
def d25(t: Tables):
    rows = t.signals.where("node_type = 'Need'").groupBy(geo.cell(F.col("lat")).alias("y"), geo.cell(F.col("lng")).alias("x"))
    return rows.agg(F.count("*").alias("n"), rounded(F.avg("lat")).alias("lat"), rounded(F.avg("lng")).alias("lng")).where("n >= 2")


def geohash_sql(lat: str, lng: str) -> str:
    x_, y_ = f"CAST(floor(({lng} + 180) / 360 * 8192) AS BIGINT)", f"CAST(floor(({lat} + 90) / 180 * 4096) AS BIGINT)"
    out = []
    for c in range(5):
        digit = " + ".join(f"((({x_ if b % 2 == 0 else y_}) >> {(12 if b % 2 == 0 else 11) - b // 2}) & 1) * {1 << 4 - (b - 5 * c)}" for b in range(5 * c, 5 * c + 5))
        out.append(f"substring('{geo.GEOHASH}', CAST({digit} AS INTEGER) + 1, 1)")
    return " || ".join(out)


@query("d26_beacons", sql(f"SELECT cell, count(*) AS n, {r6('avg(lat)')} AS lat, {r6('avg(lng)')} AS lng, least(count(*) / 10.0, 1.0) AS priority FROM (SELECT *, {geohash_sql('lat', 'lng')} AS cell FROM signals WHERE review_status = 'live' AND epoch({NOW}) - epoch(extracted_at) <= 60 * 86400) GROUP BY 1 HAVING count(*) >= 3", "signals"))
def d26(t: Tables):
    age = F.unix_seconds(d.now().cast("timestamp")) - F.unix_seconds(F.col("extracted_at").cast("timestamp"))
    out = agg.beacons(t.signals.where("review_status = 'live'").where(age <= 60 * 86400), 3, 10.0)
    return out.select("cell", "n", rounded(F.col("lat")).alias("lat"), rounded(F.col("lng")).alias("lng"), "priority")


@query("d27_news_beacons", sql(f"SELECT cell, n, priority, len(terms) AS terms FROM (SELECT {geohash_sql('lat', 'lng')} AS cell, count(*) AS n, least(count(*) / 5.0, 1.0) AS priority, list(DISTINCT lang) AS terms FROM signals WHERE node_type = 'Notice' GROUP BY 1 HAVING count(*) >= 2)", "signals"))
def d27(t: Tables):
    rows = t.signals.where("node_type = 'Notice'").groupBy(geo.geohash(F.col("lat"), F.col("lng")).alias("cell"))
    return rows.agg(F.count("*").alias("n"), F.least(F.count("*") / 5.0, F.lit(1.0)).alias("priority"), F.countDistinct("lang").alias("terms")).where("n >= 2")


@query("d28_echo_inputs", sql(f"SELECT situation_id, n, types, entities, {r6('CASE WHEN n <= 1 THEN 0 ELSE 1 - sqrt(least(types * 1.0 / n, 1) * least(entities * 1.0 / n, 1)) END')} AS echo FROM (SELECT situation_id, count(DISTINCT s.id) AS n, count(DISTINCT node_type) AS types, count(DISTINCT a.actor_id) AS entities FROM evidences e JOIN signals s ON s.id = e.signal_id LEFT JOIN acted_in a ON a.signal_id = s.id GROUP BY 1 HAVING count(DISTINCT s.id) >= 5)", "evidences", "signals", "acted_in"))
def d28(t: Tables):
    rows = t.evidences.join(t.signals.select(F.col("id").alias("signal_id"), "node_type"), "signal_id").join(t.acted_in, "signal_id", "left").groupBy("situation_id")
    rows = rows.agg(F.countDistinct("signal_id").alias("n"), F.countDistinct("node_type").alias("types"), F.countDistinct("actor_id").alias("entities")).where("n >= 5")
    return rows.withColumn("echo", rounded(s.echo_score(F.col("types"), F.col("entities"), F.col("n"))))


@query("d29_dashboard", sql("SELECT 'signals' AS metric, count(*) AS n FROM signals UNION ALL SELECT 'live', count(*) FROM signals WHERE review_status = 'live' UNION ALL SELECT 'stories', count(*) FROM stories UNION ALL SELECT 'actors', count(*) FROM actors UNION ALL SELECT 'open issues', count(*) FROM issues WHERE status = 'open' UNION ALL SELECT 'active sources', count(*) FROM sources WHERE active", "signals", "stories", "actors", "issues", "sources"))
def d29(t: Tables):
    parts = {"signals": t.signals, "live": t.signals.where("review_status = 'live'"), "stories": t.stories, "actors": t.actors, "open issues": t.issues.where("status = 'open'"), "active sources": t.sources.where("active")}
    return agg.counted(parts)


@query("d30_landscape_brief", sql(f"SELECT 'story' AS kind, id FROM (SELECT id FROM stories WHERE epoch({NOW}) - epoch(updated_at) <= 14 * 86400 ORDER BY energy DESC, id LIMIT 20) UNION ALL SELECT 'situation', id FROM (SELECT id FROM situations WHERE temperature > 0.1 ORDER BY temperature DESC, id LIMIT 20) UNION ALL SELECT 'tension', id FROM (SELECT id FROM signals WHERE node_type = 'Tension' ORDER BY extracted_at DESC, id LIMIT 50)", "stories", "situations", "signals"))
def d30(t: Tables):
    age = F.unix_seconds(d.now().cast("timestamp")) - F.unix_seconds(F.col("updated_at").cast("timestamp"))
    a = t.stories.where(age <= 14 * 86400).orderBy(F.desc("energy"), "id").limit(20).select(F.lit("story").alias("kind"), "id")
    b = t.situations.where("temperature > 0.1").orderBy(F.desc("temperature"), "id").limit(20).select(F.lit("situation").alias("kind"), "id")
    c = t.signals.where("node_type = 'Tension'").orderBy(F.desc("extracted_at"), "id").limit(50).select(F.lit("tension").alias("kind"), "id")
    return a.unionByName(b).unionByName(c)


@query("d31_evidence_dedup", sql("SELECT signal_id, count(DISTINCT source_url) AS kept, count(*) - count(DISTINCT source_url) AS dropped, count(DISTINCT source_url) - 1 AS corroboration FROM evidence GROUP BY 1", "evidence"))
def d31(t: Tables):
    n = t.evidence.groupBy("signal_id").agg(F.countDistinct("source_url").alias("kept"), F.count("*").alias("all"))
    return n.select("signal_id", "kept", (F.col("all") - F.col("kept")).alias("dropped"), (F.col("kept") - 1).alias("corroboration"))


@query("d32_abandoned", sql("SELECT count(*) AS n FROM sources WHERE empty_runs >= 10 AND method <> 'curated'", "sources"))
def d32(t: Tables):
    return t.sources.where("empty_runs >= 10 and method <> 'curated'").agg(F.count("*").alias("n"))


#: Greedy circles, visited by id, as a fold over the points of a zoom.
CIRCLES = """
    list_reduce(
        list_prepend([]::STRUCT(id BIGINT, x DOUBLE, y DOUBLE, sx DOUBLE, sy DOUBLE, n BIGINT)[],
            list_transform(p, lambda a: [{'id': a.id, 'x': a.x, 'y': a.y, 'sx': a.x * a.n, 'sy': a.y * a.n, 'n': a.n}])),
        lambda done, a: CASE
            WHEN len(list_filter(done, lambda c: (c.x - a[1].x) * (c.x - a[1].x) + (c.y - a[1].y) * (c.y - a[1].y) <= r * r)) = 0 THEN list_concat(done, a)
            ELSE list_transform(done, lambda c: CASE
                WHEN c.id = list_filter(done, lambda e: (e.x - a[1].x) * (e.x - a[1].x) + (e.y - a[1].y) * (e.y - a[1].y) <= r * r)[1].id
                THEN {'id': c.id, 'x': c.x, 'y': c.y, 'sx': c.sx + a[1].sx, 'sy': c.sy + a[1].sy, 'n': c.n + a[1].n} ELSE c END) END)
"""


@query(
    "d33_map_clusters",
    f"""
    WITH RECURSIVE places AS (
        SELECT doc_id AS id, 44.5 + (doc_id * 7) % 100 / 100.0 AS lat, -93.8 + (doc_id * 13) % 100 / 100.0 AS lng FROM documents),
    world AS (
        SELECT id, CAST(lng AS DOUBLE) / 360.0 + 0.5 AS x,
               0.5 - 0.25 * ln((1 + sin(radians(CAST(lat AS DOUBLE)))) / (1 - sin(radians(CAST(lat AS DOUBLE))))) / pi() AS y FROM places),
    points AS (SELECT min(id) AS id, x, y, count(*) AS n FROM world GROUP BY x, y),
    zooms AS (
        SELECT 15 AS zoom, list({{'id': id, 'x': x, 'y': y, 'n': n}} ORDER BY id) AS p FROM points
        UNION ALL
        SELECT zoom, list_transform(list_sort(list_transform(c, lambda e: {{'id': e.id, 'x': e.sx / e.n, 'y': e.sy / e.n, 'n': e.n}})), lambda e: e)
        FROM (SELECT zoom - 1 AS zoom, {CIRCLES} AS c FROM (SELECT zoom, p, 50 / (512 * pow(2, zoom - 1)) AS r FROM zooms WHERE zoom > 0)))
    SELECT CAST(zoom AS INTEGER) AS zoom, e.id AS id, {r6("degrees(2 * atan(exp((0.5 - e.y) * (2 * pi()))) - pi() / 2)")} AS lat, {r6("(e.x - 0.5) * 360.0")} AS lng, e.n AS n
    FROM (SELECT zoom, unnest(p) AS e FROM zooms WHERE zoom < 15)
    """,
)
def d33(t: Tables):
    rows = map_clusters.by_zoom(t.signals.select("id", "lat", "lng"))
    return rows.select("zoom", "id", rounded(F.col("lat")).alias("lat"), rounded(F.col("lng")).alias("lng"), "n")


@query("d34_engagement", "SELECT user_id, CASE WHEN n >= 1000 THEN printf('%.1fk likes', floor(n / 100.0 + 0.5) / 10) ELSE CAST(n AS VARCHAR) || ' likes' END AS label FROM (SELECT user_id, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS n FROM events GROUP BY 1)")
def d34(t: Tables):
    n = t.events.groupBy("user_id").agg(F.sum(F.from_json("props", "k long")["k"]).alias("n"))
    return n.select("user_id", x.count_label(F.col("n"), "likes").alias("label"))


@query("d35_fitness", f"SELECT user_id % 10 AS world, {r6('greatest(0.7 * avg(value) / 100 + 0.3 * avg(CASE WHEN event_id % 4 = 0 THEN 1.0 ELSE (event_id % 4 - 1) / 3.0 END) - 0.05 * count(*) FILTER (WHERE event_type = $q$error$q$) / count(*), 0)').replace('$q$', chr(39))} AS fitness FROM events GROUP BY 1")
def d35(t: Tables):
    passed = F.when(F.col("event_id") % 4 == 0, 1.0).otherwise((F.col("event_id") % 4 - 1) / 3.0)
    score = 0.7 * F.avg("value") / 100 + 0.3 * F.avg(passed) - 0.05 * F.count(F.when(F.col("event_type") == "error", 1)) / F.count("*")
    return t.events.groupBy((F.col("user_id") % 10).alias("world")).agg(rounded(F.greatest(score, F.lit(0.0))).alias("fitness"))


@query("e01_first_per_title", sql("SELECT min(id) AS id FROM signals GROUP BY lower(trim(title)), node_type", "signals"))
def e01(t: Tables):
    return t.signals.groupBy(x.normalized_title(F.col("title")).alias("key"), "node_type").agg(F.min("id").alias("id")).select("id")


@query("e02_top_per_tension", sql(f"SELECT tension_id, signal_id FROM (SELECT *, row_number() OVER (PARTITION BY tension_id ORDER BY strength DESC, signal_id, edge) AS place FROM {EDGES}) WHERE place <= 3", "responds_to", "drawn_to"))
def e02(t: Tables):
    from ..operators.filters import top_per
    from ..operators.graph import responders

    return top_per(responders(t.responds_to, t.drawn_to), ["tension_id"], [F.desc("strength"), F.col("signal_id"), F.col("edge")], 3).select("tension_id", "signal_id")


@query("e03_every_nth", sql("SELECT id FROM (SELECT id, row_number() OVER (ORDER BY weight DESC, id) AS place, count(*) OVER () AS n FROM sources WHERE active) WHERE (place - 1) % CAST(ceil(n / 20.0) AS BIGINT) = 0", "sources"))
def e03(t: Tables):
    return agg.every_nth(t.sources.where("active"), [F.desc("weight"), F.col("id")], 20).select("id")


@query("e04_story_velocity", sql(f"SELECT c.story_id, {r6('CASE WHEN o.signal_count IS NULL THEN c.n / 7.0 ELSE (c.n - o.signal_count) / 7.0 END')} AS velocity FROM (SELECT story_id, count(*) AS n FROM contains GROUP BY 1) c LEFT JOIN (SELECT story_id, arg_min(signal_count, (taken_at, event_id)) AS signal_count FROM snapshots WHERE taken_at BETWEEN {NOW} - INTERVAL 8 DAY AND {NOW} - INTERVAL 6 DAY GROUP BY 1) o USING (story_id)", "contains", "snapshots"))
def e04(t: Tables):
    n = t.contains.groupBy("story_id").agg(F.count("*").alias("n"))
    old = agg.snapshot_before(t.snapshots, d.now())
    return n.join(old, "story_id", "left").select("story_id", rounded((F.col("n") - F.coalesce("signal_count", F.lit(0))) / 7.0).alias("velocity"))


@query("e05_net_new_entities", sql(f"SELECT situation_id, {r6('least(greatest(count(*) FILTER (WHERE a <= 7 * 86400) / 3.0, count(*) FILTER (WHERE a <= 30 * 86400) / 5.0), 1)')} AS velocity FROM (SELECT situation_id, {OWN} AS host, epoch({NOW}) - min(epoch(extracted_at)) AS a FROM evidences JOIN signals s ON s.id = signal_id GROUP BY 1, 2) GROUP BY 1", "evidences", "signals"))
def e05(t: Tables):
    return agg.entity_velocity(t.evidences, t.signals, d.now()).select("situation_id", rounded(F.col("velocity")).alias("velocity"))


@query("e06_mode_location", sql(f"SELECT actor_id, arg_min(cell, (-n, cell)) AS cell FROM (SELECT actor_id, {geohash_sql('lat', 'lng')} AS cell, count(*) AS n FROM acted_in JOIN signals ON id = signal_id GROUP BY 1, 2) GROUP BY 1", "acted_in", "signals"))
def e06(t: Tables):
    n = t.acted_in.join(t.signals, F.col("signal_id") == F.col("id")).groupBy("actor_id", geo.geohash(F.col("lat"), F.col("lng")).alias("cell")).agg(F.count("*").alias("n"))
    return n.groupBy("actor_id").agg(F.min_by("cell", F.struct(-F.col("n"), F.col("cell"))).alias("cell"))
