"""Scans, filters, rankings and joins (A to C, F, G of the inventory)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import domain as d
from ..checkpoints import written
from ..domain import NOW, r6, rounded, sql
from ..functions import geo
from ..functions import scoring as s
from ..functions import url as u
from ..operators import around, filters, graph
from .registry import Tables, query

BOX = geo.box(*d.CENTRE, 40.0)
IN_BOX = f"lat BETWEEN {BOX[0]!r} AND {BOX[1]!r} AND lng BETWEEN {BOX[2]!r} AND {BOX[3]!r}"
FRESH = f"""CASE node_type WHEN 'Gathering' THEN is_recurring OR starts_at IS NULL OR epoch({NOW}) - epoch(coalesce(ends_at, starts_at)) <= 168 * 3600
    WHEN 'Need' THEN epoch({NOW}) - epoch(extracted_at) <= 60 * 86400 WHEN 'Notice' THEN epoch({NOW}) - epoch(extracted_at) <= 90 * 86400
    ELSE epoch({NOW}) - epoch(confirmed_at) <= 30 * 86400 END"""
VISIBLE = f"confidence >= 0.4 AND lat <> 0 AND review_status = 'live' AND ({FRESH})"
EDGES = "(SELECT *, 'responds_to' AS edge FROM responds_to UNION ALL SELECT *, 'drawn_to' AS edge FROM drawn_to)"


@query("a01_signal_scan", sql("SELECT node_type, count(*) AS n, " + r6("avg(confidence)") + " AS mean_confidence FROM signals WHERE confidence >= 0.4 GROUP BY 1", "signals"))
def a01(t: Tables):
    return t.signals.where("confidence >= 0.4").groupBy("node_type").agg(F.count("*").alias("n"), rounded(F.avg("confidence")).alias("mean_confidence"))


@query("a06_point_lookup", sql("SELECT s.id, node_type, s.source_url, count(e.id) AS pieces FROM signals s LEFT JOIN evidence e ON e.signal_id = s.id WHERE s.id = 42 GROUP BY 1, 2, 3", "signals", "evidence"))
def a06(t: Tables):
    e = t.evidence.select("signal_id", F.col("id").alias("e"))
    return t.signals.where("id = 42").join(e, F.col("id") == F.col("signal_id"), "left").groupBy("id", "node_type", "source_url").agg(F.count("e").alias("pieces"))


@query("a07_archive_recent", "SELECT event_id, event_type, user_id FROM events ORDER BY ts DESC, event_id LIMIT 100")
def a07(t: Tables):
    return t.events.orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "event_type", "user_id")


@query("a08_archive_by_source", "SELECT event_id, event_type, value FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id LIMIT 50")
def a08(t: Tables):
    return t.events.where("user_id = 7").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "event_type", "value")


@query(
    "a11_content_kind",
    """SELECT page_id, CASE WHEN regexp_matches(lower(ltrim(substring(html, 1, 500))), '^(<!doctype html|<html)') THEN 'html'
       WHEN regexp_matches(lower(substring(html, 1, 500)), '<rss|<feed|<rdf') THEN 'feed' WHEN starts_with(html, '%PDF') THEN 'pdf' ELSE 'raw' END AS kind FROM pages""",
)
def a11(t: Tables):
    head = F.lower(F.substring("html", 1, 500))
    kind = F.when(F.ltrim(head).rlike("^(<!doctype html|<html)"), "html").when(head.rlike("<rss|<feed|<rdf"), "feed").when(F.col("html").startswith("%PDF"), "pdf").otherwise("raw")
    return t.pages.select("page_id", kind.alias("kind"))


@query("a14_freshness_ledger", "SELECT user_id, event_type, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_at FROM events GROUP BY 1, 2")
def a14(t: Tables):
    return t.events.groupBy("user_id", "event_type").agg(F.unix_seconds(F.max("ts").cast("timestamp")).alias("last_at"))


@query("a15_run_log", "SELECT user_id AS run, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def a15(t: Tables):
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return t.events.select(F.col("user_id").alias("run"), "event_id", "event_type", seq.alias("seq"), F.from_json("props", "k long")["k"].alias("k"))


@query("a18_batched_evidence", sql("SELECT signal_id, count(*) AS n, CAST(sum(content_hash) AS BIGINT) AS hashes, count(DISTINCT source_url) AS urls FROM evidence WHERE signal_id IN (1, 5, 8, 13, 21, 34) GROUP BY 1", "evidence"))
def a18(t: Tables):
    items = graph.collected(t.evidence.where(F.col("signal_id").isin(1, 5, 8, 13, 21, 34)), "signal_id", "id", "content_hash", "source_url")
    return items.select("signal_id", F.size("items").cast("long").alias("n"), F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["content_hash"]).alias("hashes"), F.size(F.array_distinct("items.source_url")).cast("long").alias("urls"))


@query("b01_bounding_box", sql(f"SELECT id, {r6('lat - 10 / 111.0')} AS min_lat, {r6('lat + 10 / 111.0')} AS max_lat, {r6('lng - 10 / (111.0 * cos(radians(lat)))')} AS min_lng, {r6('lng + 10 / (111.0 * cos(radians(lat)))')} AS max_lng FROM signals", "signals"))
def b01(t: Tables):
    dlng = 10 / (111.0 * F.cos(F.radians("lat")))
    return t.signals.select("id", *(rounded(c).alias(n) for n, c in (("min_lat", F.col("lat") - 10 / 111.0), ("max_lat", F.col("lat") + 10 / 111.0), ("min_lng", F.col("lng") - dlng), ("max_lng", F.col("lng") + dlng))))


FUZZED = ", ".join(f"{r6(f'CASE sensitivity WHEN $e$elevated$e$ THEN round({c} / 0.005) * 0.005 WHEN $e$sensitive$e$ THEN round({c} / 0.05) * 0.05 ELSE {c} END')} AS {c}" for c in ("lat", "lng")).replace("$e$", "'")
PRECISION = "CASE sensitivity WHEN 'sensitive' THEN 'approximate' WHEN 'elevated' THEN 'neighborhood' ELSE 'exact' END AS precision"


@query("b02_signals_in_bounds", sql(f"SELECT id, node_type, {FUZZED}, {PRECISION}, heat FROM (SELECT * FROM signals WHERE {VISIBLE} AND {IN_BOX} ORDER BY heat DESC, confidence DESC, id LIMIT 100)", "signals"))
def b02(t: Tables):
    return filters.signals_in_bounds(t.signals, BOX, d.now()).select("id", "node_type", rounded(F.col("lat")).alias("lat"), rounded(F.col("lng")).alias("lng"), "precision", "heat")


@query(
    "b03_signals_near",
    sql(f"""SELECT id, node_type, triangulation FROM (SELECT *, row_number() OVER (PARTITION BY node_type ORDER BY triangulation DESC, heat DESC, confidence DESC, confirmed_at DESC, id) AS place
        FROM (SELECT s.*, coalesce(b.tri, 0) AS triangulation FROM signals s LEFT JOIN (SELECT signal_id, max(type_diversity) AS tri FROM contains JOIN stories st ON st.id = story_id GROUP BY 1) b ON b.signal_id = s.id
        WHERE {VISIBLE} AND {IN_BOX})) WHERE place <= 200""", "signals", "stories", "contains"),
)
def b03(t: Tables):
    return filters.signals_near(t.signals, t.stories, t.contains, *d.CENTRE, 40.0, d.now(), 200).select("id", "node_type", F.col("triangulation").cast("long").alias("triangulation"))


KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(s.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lng - a.lng) / 2), 2))))"


@query(
    "b03_signals_near_actors",
    sql(f"""SELECT actor_id, id, {r6("km")} AS km, CAST(place AS INTEGER) AS place FROM (
        SELECT *, row_number() OVER (PARTITION BY actor_id ORDER BY heat DESC, confidence DESC, id) AS place FROM (
            SELECT a.id AS actor_id, s.id, s.heat, s.confidence, a.id % 9 + 1 AS radius, {KM} AS km
            FROM actors a JOIN (SELECT * FROM signals WHERE {VISIBLE}) s ON abs(s.lat - a.lat) <= 0.2) WHERE km <= radius) WHERE place <= 20""", "signals", "actors"),
)
def b03_actors(t: Tables):
    """The hottest visible signals around each actor, within one to nine kilometres."""
    # circles alike are searched once; of points in one place, a circle holds all or none, so its first twenty are enough
    shown, order = t.signals.where(filters.visible(d.now())), [F.desc("heat"), F.desc("confidence"), F.col("id")]
    shown = filters.top_per(shown.select("id", "lat", "lng", "heat", "confidence"), ["lat", "lng"], order, 20)
    asked = t.actors.select(F.col("id").alias("actor_id"), "lat", "lng", (F.col("id") % 9 + 1).alias("radius"))
    circles = written(asked.select("lat", "lng", "radius").dropna().distinct().withColumn("circle", F.monotonically_increasing_id()), "circles")
    near = around.within(circles, shown, F.col("radius"), "circle").select(F.col("centre_id").alias("circle"), F.col("point_id").alias("id"), "km")
    first = filters.top_per(near.join(shown.select("id", "heat", "confidence").distinct(), "id"), ["circle"], order, 20)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("heat")).alias("h"), (-F.col("confidence")).alias("c"), "id", "km")))  # twenty at most
    lists = first.groupBy("circle").agg(ranked.alias("near")).join(circles, "circle")
    each = asked.join(lists, ["lat", "lng", "radius"]).select("actor_id", F.posexplode("near").alias("place", "x")).withColumn("place", F.col("place") + 1)
    several = written(asked.groupBy("actor_id").count().where("count > 1").select("actor_id"), "several")  # actors that share an id share its twenty
    place = F.row_number().over(Window.partitionBy("actor_id").orderBy("x"))
    more = each.join(several, "actor_id", "left_semi").withColumn("place", place).where("place <= 20")
    rows = each.join(several, "actor_id", "left_anti").unionByName(more)
    return rows.select("actor_id", "x.id", rounded(F.col("x.km")).alias("km"), "place")


@query("b04_stories_in_bounds", sql(f"SELECT id, headline, energy FROM stories WHERE status = 'live' AND {IN_BOX} ORDER BY energy DESC, id LIMIT 20", "stories"))
def b04(t: Tables):
    return filters.inside(t.stories.where("status = 'live'"), BOX).orderBy(F.desc("energy"), "id").limit(20).select("id", "headline", "energy")


@query("b04_actors_in_bounds", sql(f"SELECT id, name FROM actors WHERE {IN_BOX} ORDER BY last_active DESC, id LIMIT 50", "actors"))
def b04a(t: Tables):
    return filters.inside(t.actors, BOX).orderBy(F.desc("last_active"), "id").limit(50).select("id", "name")


@query("b05_unexpired", sql(f"SELECT id, node_type FROM signals WHERE {FRESH}", "signals"))
def b05(t: Tables):
    fresh = s.unexpired(*(F.col(c) for c in ("node_type", "starts_at", "ends_at", "is_recurring", "extracted_at", "confirmed_at")), d.now())
    return t.signals.where(fresh).select("id", "node_type")


@query(
    "b06_display_filter",
    sql(f"""SELECT id FROM signals WHERE (CASE node_type WHEN 'Gathering' THEN is_recurring OR starts_at IS NULL OR NOT floor((epoch({NOW}) - epoch(coalesce(ends_at, starts_at))) / 3600) > 168
        WHEN 'Need' THEN NOT floor((epoch({NOW}) - epoch(extracted_at)) / 86400) > 60 WHEN 'Notice' THEN NOT floor((epoch({NOW}) - epoch(extracted_at)) / 86400) > 90 ELSE true END)
        AND ((node_type = 'Gathering' AND is_recurring) OR floor((epoch({NOW}) - epoch(confirmed_at)) / 86400) <= 30)""", "signals"),
)
def b06(t: Tables):
    typed = (
        F.when(F.col("node_type") == "Gathering", F.col("is_recurring") | F.col("starts_at").isNull() | ~(s.hours_between(F.coalesce("ends_at", "starts_at"), d.now()) > 168))
        .when(F.col("node_type") == "Need", ~(s.days_between(F.col("extracted_at"), d.now()) > 60))
        .when(F.col("node_type") == "Notice", ~(s.days_between(F.col("extracted_at"), d.now()) > 90))
        .otherwise(True)
    )
    general = ((F.col("node_type") == "Gathering") & F.col("is_recurring")) | (s.days_between(F.col("confirmed_at"), d.now()) <= 30)
    return t.signals.where(typed & general).select("id")


@query("b07_fuzzed", sql(f"SELECT id, {FUZZED}, {PRECISION} FROM signals", "signals"))
def b07(t: Tables):
    return filters.fuzzed(t.signals).select("id", rounded(F.col("lat")).alias("lat"), rounded(F.col("lng")).alias("lng"), "precision")


@query("b08_stories_by_arc", sql("SELECT id, headline, energy FROM stories WHERE arc = 'growing' AND status = 'live' ORDER BY energy DESC, id LIMIT 20", "stories"))
def b08(t: Tables):
    return t.stories.where("arc = 'growing' AND status = 'live'").orderBy(F.desc("energy"), "id").limit(20).select("id", "headline", "energy")


@query("b09_blocked_urls", "SELECT page_id FROM pages WHERE contains(url, 'blog.') OR contains(url, '/es/') OR contains(url, 'example.net/fr')")
def b09(t: Tables):
    patterns = t.spark.createDataFrame([("blog.",), ("/es/",), ("example.net/fr",)], "pattern string")
    return filters.blocked(t.pages, patterns).select("page_id")


@query("b10_new_content", sql("SELECT page_id FROM pages p WHERE NOT EXISTS (SELECT 1 FROM evidence e WHERE e.content_hash = p.page_id % 60 AND e.source_url = 'https://s' || (p.page_id % 37) || '.example.org/p/' || (p.page_id % 60))", "evidence"))
def b10(t: Tables):
    i = F.col("page_id")
    pages = t.pages.select("page_id", (i % 60).alias("content_hash"), F.concat(F.lit("https://s"), (i % 37).cast("string"), F.lit(".example.org/p/"), (i % 60).cast("string")).alias("source_url"))
    return pages.join(t.evidence, ["content_hash", "source_url"], "left_anti").select("page_id")


@query("b12_region_sources", sql(f"SELECT id FROM sources c WHERE active AND (signals_produced = 0 OR EXISTS (SELECT 1 FROM evidence e JOIN signals s ON s.id = e.signal_id WHERE {IN_BOX} AND split_part(e.source_url, '/', 3) = split_part(c.value, '/', 3)))", "sources", "evidence", "signals"))
def b12(t: Tables):
    seen = t.evidence.join(filters.inside(t.signals, BOX).select(F.col("id").alias("signal_id")), "signal_id").select(u.domain(F.col("source_url")).alias("host")).distinct()
    active = t.sources.where("active").withColumn("host", u.domain(F.col("value")))
    return active.where("signals_produced = 0").select("id").union(active.where("signals_produced <> 0").join(seen, "host", "left_semi").select("id"))


DUE = f"active AND (last_scraped IS NULL OR epoch({NOW}) - epoch(last_scraped) > coalesce(cadence_hours, 24) * 3600)"


@query("b13_due_sources", sql(f"SELECT count(*) AS due, count(*) FILTER (WHERE last_scraped IS NULL) AS never, CAST(floor(epoch(min(last_scraped))) AS BIGINT) AS oldest FROM sources WHERE {DUE}", "sources"))
def b13(t: Tables):
    return filters.due_sources(t.sources, d.now()).agg(F.count("*").alias("due"), F.count(F.when(F.col("last_scraped").isNull(), 1)).alias("never"), F.unix_seconds(F.min("last_scraped").cast("timestamp")).alias("oldest"))


@query("b16_link_filter", "SELECT page_id, len(list_filter(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)), lambda x: regexp_matches(x, '^https?://') AND NOT regexp_matches(lower(split_part(x, '?', 1)), '\\.(?:css|js|png|jpg|jpeg|gif|svg|woff|woff2|ico|webp|mp3|mp4)$'))) AS links FROM pages")
def b16(t: Tables):
    from ..functions.text import hrefs

    return t.pages.select("page_id", F.size(F.filter(hrefs(F.col("html")), u.promotable)).cast("long").alias("links"))


@query("b17_crawl_filter", "SELECT page_id FROM pages WHERE contains(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/en/') AND NOT contains(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '.html')")
def b17(t: Tables):
    return t.pages.where(u.crawlable(F.col("url"), ["/en/"], [".html"])).select("page_id")


@query("b19_event_facets", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def b19(t: Tables):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"))


@query("b20_null_island", sql("SELECT count(*) AS kept FROM signals WHERE NOT (abs(lat) < 0.01 AND abs(lng) < 0.01)", "signals"))
def b20(t: Tables):
    return t.signals.where(~((F.abs("lat") < 0.01) & (F.abs("lng") < 0.01))).agg(F.count("*").alias("kept"))


@query("c01_story_signals", sql("SELECT story_id, id, row_number() OVER (PARTITION BY story_id ORDER BY confidence DESC, id) AS place FROM contains JOIN signals ON id = signal_id", "contains", "signals"))
def c01(t: Tables):
    place = F.row_number().over(Window.partitionBy("story_id").orderBy(F.desc("confidence"), "id")).cast("long")
    return t.contains.join(t.signals, F.col("signal_id") == F.col("id")).select("story_id", "id", place.alias("place"))


@query("c02_story_evidence", sql("SELECT story_id, count(*) AS pieces, count(DISTINCT e.source_url) AS urls FROM contains c JOIN evidence e USING (signal_id) GROUP BY 1", "contains", "evidence"))
def c02(t: Tables):
    return t.contains.join(t.evidence, "signal_id").groupBy("story_id").agg(F.count("*").alias("pieces"), F.countDistinct("source_url").alias("urls"))


@query("c03_tension_responses", sql(f"SELECT tension_id, signal_id, edge, {r6('strength')} AS strength, {r6('confidence')} AS confidence FROM {EDGES} e JOIN signals s ON s.id = signal_id", "responds_to", "drawn_to", "signals"))
def c03(t: Tables):
    e = graph.responders(t.responds_to, t.drawn_to).join(t.signals, F.col("signal_id") == F.col("id"))
    return e.select("tension_id", "signal_id", "edge", rounded(F.col("strength")).alias("strength"), rounded(F.col("confidence")).alias("confidence"))


@query("c04_story_tension_responders", sql("SELECT story_id, c.signal_id AS tension_id, count(DISTINCT r.signal_id) AS responders FROM contains c JOIN responds_to r ON r.tension_id = c.signal_id GROUP BY 1, 2", "contains", "responds_to"))
def c04(t: Tables):
    return t.contains.withColumnRenamed("signal_id", "tension_id").join(t.responds_to, "tension_id").groupBy("story_id", "tension_id").agg(F.countDistinct("signal_id").alias("responders"))


@query("c05_actor_stories", sql("SELECT DISTINCT actor_id, story_id FROM acted_in JOIN contains USING (signal_id)", "acted_in", "contains"))
def c05(t: Tables):
    return t.acted_in.join(t.contains, "signal_id").select("actor_id", "story_id").distinct()


@query("c06_actor_sources", sql(f"SELECT a.id, count(s.id) AS n_sources FROM actors a LEFT JOIN sources s ON split_part(s.value, '/', 3) = a.domain WHERE {IN_BOX} GROUP BY 1", "actors", "sources"))
def c06(t: Tables):
    s_ = t.sources.select(F.col("id").alias("source_id"), u.domain(F.col("value")).alias("domain"))
    return filters.inside(t.actors, BOX).join(s_, "domain", "left").groupBy("id").agg(F.count("source_id").alias("n_sources"))


@query("c08_signal_situations", sql("SELECT signal_id, situation_id, row_number() OVER (PARTITION BY signal_id ORDER BY temperature DESC, situation_id) AS place FROM evidences JOIN situations ON id = situation_id", "evidences", "situations"))
def c08(t: Tables):
    place = F.row_number().over(Window.partitionBy("signal_id").orderBy(F.desc("temperature"), "situation_id")).cast("long")
    return t.evidences.join(t.situations, F.col("situation_id") == F.col("id")).select("signal_id", "situation_id", place.alias("place"))


@query("c09_unresponded_tensions", sql(f"SELECT s.id, count(DISTINCT e.signal_id) AS responses FROM signals s LEFT JOIN {EDGES} e ON e.tension_id = s.id WHERE node_type = 'Tension' AND review_status = 'live' AND {IN_BOX} AND s.id NOT IN (SELECT signal_id FROM contains) GROUP BY 1 HAVING count(DISTINCT e.signal_id) < 2", "signals", "contains", "responds_to", "drawn_to"))
def c09(t: Tables):
    return graph.unresponded_tensions(t.signals, t.contains, graph.responders(t.responds_to, t.drawn_to), BOX).select("id", "responses")


@query("c10_tension_hubs", sql(f"SELECT s.id, count(DISTINCT r.id) AS size, CAST(sum(DISTINCT r.id) AS BIGINT) AS total FROM signals s JOIN {EDGES} e ON e.tension_id = s.id JOIN signals r ON r.id = e.signal_id AND r.node_type IN ('Gathering', 'Aid', 'Need') WHERE s.node_type = 'Tension' AND s.id NOT IN (SELECT signal_id FROM contains) GROUP BY 1 HAVING count(DISTINCT r.id) >= 2", "signals", "contains", "responds_to", "drawn_to"))
def c10(t: Tables):
    hubs = graph.tension_hubs(t.signals, t.contains, graph.responders(t.responds_to, t.drawn_to))
    return hubs.select("id", "size", "total")


@query("c11_story_growth", sql(f"SELECT DISTINCT c.story_id, e.signal_id FROM contains c JOIN signals s ON s.id = c.signal_id AND s.node_type = 'Tension' JOIN {EDGES} e ON e.tension_id = s.id WHERE NOT EXISTS (SELECT 1 FROM contains x WHERE x.story_id = c.story_id AND x.signal_id = e.signal_id)", "contains", "signals", "responds_to", "drawn_to"))
def c11(t: Tables):
    return graph.story_growth(t.contains, t.signals, graph.responders(t.responds_to, t.drawn_to))


@query("c12_unassigned_signals", sql("SELECT id FROM signals WHERE id NOT IN (SELECT signal_id FROM evidences) AND id IN (SELECT id FROM signal_vectors)", "signals", "evidences", "signal_vectors"))
def c12(t: Tables):
    return t.signals.join(t.evidences.select(F.col("signal_id").alias("id")), "id", "left_anti").join(t.signal_vectors, "id", "left_semi").select("id")


@query("c13_signals_without_actors", sql(f"SELECT id FROM signals WHERE {IN_BOX} AND id NOT IN (SELECT signal_id FROM acted_in) ORDER BY extracted_at DESC, id LIMIT 200", "signals", "acted_in"))
def c13(t: Tables):
    rows = filters.inside(t.signals, BOX).join(t.acted_in.select(F.col("signal_id").alias("id")), "id", "left_anti")
    return rows.orderBy(F.desc("extracted_at"), "id").limit(200).select("id")


@query("c14_tension_linker_targets", sql(f"SELECT id FROM signals WHERE node_type IN ('Gathering', 'Aid', 'Need') AND confidence >= 0.5 AND {IN_BOX} AND id NOT IN (SELECT signal_id FROM responds_to)", "signals", "responds_to"))
def c14(t: Tables):
    rows = filters.inside(t.signals.where("node_type in ('Gathering', 'Aid', 'Need') and confidence >= 0.5"), BOX)
    return rows.join(t.responds_to.select(F.col("signal_id").alias("id")), "id", "left_anti").select("id")


@query(
    "c15_investigation_targets",
    sql(f"""SELECT id, priority FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY priority, id) AS place FROM (
        SELECT s.id, s.source, min(CASE WHEN node_type = 'Tension' AND epoch({NOW}) - epoch(extracted_at) < 30 * 86400 THEN 1 WHEN node_type = 'Need' AND severity IN ('high', 'critical') THEN 2 WHEN st.arc = 'emerging' THEN 3 END) AS priority
        FROM signals s LEFT JOIN contains c ON c.signal_id = s.id LEFT JOIN stories st ON st.id = c.story_id LEFT JOIN (SELECT signal_id, count(*) AS n FROM evidence GROUP BY 1) e ON e.signal_id = s.id
        WHERE coalesce(e.n, 0) < 50 GROUP BY 1, 2) WHERE priority IS NOT NULL) WHERE place = 1""", "signals", "contains", "stories", "evidence"),
)
def c15(t: Tables):
    arcs = t.contains.join(t.stories.where("arc = 'emerging'").select(F.col("id").alias("story_id")), "story_id").select(F.col("signal_id").alias("id"), F.lit(True).alias("emerging")).distinct()
    pieces = t.evidence.groupBy(F.col("signal_id").alias("id")).count()
    age = F.unix_seconds(d.now().cast("timestamp")) - F.unix_seconds(F.col("extracted_at").cast("timestamp"))
    rows = t.signals.join(arcs, "id", "left").join(pieces, "id", "left").where(F.coalesce("count", F.lit(0)) < 50)
    priority = F.when((F.col("node_type") == "Tension") & (age < 30 * 86400), 1).when((F.col("node_type") == "Need") & F.col("severity").isin("high", "critical"), 2).when(F.col("emerging"), 3)
    ranked = rows.withColumn("priority", priority).where("priority is not null")
    return filters.top_per(ranked, ["source"], [F.col("priority"), F.col("id")], 1).select("id", "priority")


@query("c16_response_finder_targets", sql(f"SELECT s.id, count(DISTINCT e.signal_id) AS responses FROM signals s LEFT JOIN {EDGES} e ON e.tension_id = s.id WHERE node_type = 'Tension' AND confidence >= 0.5 AND {IN_BOX} AND epoch({NOW}) - epoch(confirmed_at) > 14 * 86400 GROUP BY 1, heat, confidence ORDER BY responses, heat DESC, confidence DESC, s.id LIMIT 20", "signals", "responds_to", "drawn_to"))
def c16(t: Tables):
    waited = F.unix_seconds(d.now().cast("timestamp")) - F.unix_seconds(F.col("confirmed_at").cast("timestamp"))
    rows = filters.inside(t.signals.where("node_type = 'Tension' and confidence >= 0.5").where(waited > 14 * 86400), BOX)
    n = graph.response_counts(graph.responders(t.responds_to, t.drawn_to)).withColumnRenamed("tension_id", "id")
    return rows.join(n, "id", "left").withColumn("responses", F.coalesce("responses", F.lit(0))).orderBy("responses", F.desc("heat"), F.desc("confidence"), "id").limit(20).select("id", "responses")


@query("c17_gathering_finder_targets", sql(f"SELECT id FROM signals WHERE node_type = 'Tension' AND heat >= 0.1 AND epoch({NOW}) - epoch(confirmed_at) > 86400 * CASE corroboration WHEN 0 THEN 7 WHEN 1 THEN 14 WHEN 2 THEN 21 ELSE 30 END", "signals"))
def c17(t: Tables):
    waited = F.unix_seconds(d.now().cast("timestamp")) - F.unix_seconds(F.col("confirmed_at").cast("timestamp"))
    return t.signals.where("node_type = 'Tension' and heat >= 0.1").where(waited > 86400 * s.backoff_days(F.col("corroboration"))).select("id")


@query("c19_ready_situations", sql("SELECT id FROM situations WHERE id NOT IN (SELECT situation_id FROM evidences e JOIN signals s ON s.id = e.signal_id WHERE s.review_status <> 'live')", "situations", "evidences", "signals"))
def c19(t: Tables):
    held = t.evidences.join(t.signals.where("review_status <> 'live'").select(F.col("id").alias("signal_id")), "signal_id").select(F.col("situation_id").alias("id"))
    return t.situations.join(held, "id", "left_anti").select("id")


@query("c20_orphan_actors", sql("SELECT id FROM actors WHERE id NOT IN (SELECT actor_id FROM acted_in)", "actors", "acted_in"))
def c20(t: Tables):
    return graph.orphans(t.actors, t.acted_in, "actor_id").select("id")


@query("c20_orphan_evidence", sql("SELECT count(*) AS n FROM evidence WHERE signal_id NOT IN (SELECT id FROM signals WHERE review_status = 'live')", "evidence", "signals"))
def c20e(t: Tables):
    return t.evidence.join(t.signals.where("review_status = 'live'").select(F.col("id").alias("signal_id")), "signal_id", "left_anti").agg(F.count("*").alias("n"))


@query(
    "c21_duplicate_actors",
    sql("""SELECT first_value(id) OVER w AS kept, id AS merged, key FROM (SELECT a.id, replace(replace(replace(lower(trim(name)), '-', ' '), '#', ' '), '.', '') AS key, coalesce(n, 0) AS n
        FROM actors a LEFT JOIN (SELECT actor_id, count(*) AS n FROM acted_in GROUP BY 1) d ON d.actor_id = a.id) WINDOW w AS (PARTITION BY key ORDER BY n DESC, id) QUALIFY kept <> id""", "actors", "acted_in"),
)
def c21(t: Tables):
    return graph.duplicate_actors(t.actors, t.acted_in)


@query("c23_implied_queries", sql("SELECT DISTINCT s.title FROM signals s JOIN responds_to r ON r.signal_id = s.id JOIN signals x ON x.id = r.tension_id WHERE x.heat >= 0.1", "signals", "responds_to"))
def c23(t: Tables):
    hot = t.responds_to.join(t.signals.where("heat >= 0.1").select(F.col("id").alias("tension_id")), "tension_id").select(F.col("signal_id").alias("id"))
    return t.signals.join(hot, "id", "left_semi").select("title").distinct()


@query("c25_source_tensions", sql("SELECT c.id, count(DISTINCT s.signal_id) AS tensions FROM sources c LEFT JOIN (SELECT signal_id, split_part(e.source_url, '/', 3) AS host FROM evidence e JOIN signals g ON g.id = e.signal_id WHERE g.node_type = 'Tension') s ON contains(c.value, '//' || s.host || '/') GROUP BY 1", "sources", "evidence", "signals"))
def c25(t: Tables):
    tensions = t.signals.where("node_type = 'Tension'").select(F.col("id").alias("signal_id"))
    tension = t.evidence.join(tensions, "signal_id", "left_semi").select("signal_id", u.domain(F.col("source_url")).alias("host"))
    # an equality on the host instead of a scan for contained text; a host's tensions are counted once for all its sources
    of = t.sources.select("id", u.domain(F.col("value")).alias("host")).distinct()
    several = of.groupBy("id").agg(F.count("*").alias("hosts")).where("hosts > 1")  # rows that share an id: their hosts' tensions count once
    pairs = tension.distinct()
    counts = pairs.groupBy("host").agg(F.count("*").alias("tensions"))
    one = of.join(several, "id", "left_anti").join(counts, "host", "left").select("id", F.coalesce("tensions", F.lit(0)).alias("tensions"))
    more = of.join(several, "id", "left_semi").join(pairs, "host", "left").groupBy("id").agg(F.countDistinct("signal_id").alias("tensions"))
    return one.unionByName(more)


@query("c26_weak_responses", sql("SELECT signal_id, tension_id FROM responds_to JOIN signals ON id = signal_id WHERE confidence < 0.4", "responds_to", "signals"))
def c26(t: Tables):
    return t.responds_to.join(t.signals.where("confidence < 0.4").select(F.col("id").alias("signal_id")), "signal_id").select("signal_id", "tension_id")


@query("c27_source_issues", sql("SELECT source, count(*) AS open_issues FROM issues JOIN signals s ON s.id = target_id WHERE status = 'open' GROUP BY 1", "issues", "signals"))
def c27(t: Tables):
    return t.issues.where("status = 'open'").join(t.signals.select(F.col("id").alias("target_id"), "source"), "target_id").groupBy("source").agg(F.count("*").alias("open_issues"))


@query("c28_invalid_citations", sql("SELECT DISTINCT signal_id FROM evidence WHERE signal_id NOT IN (SELECT id FROM signals WHERE review_status <> 'rejected')", "evidence", "signals"))
def c28(t: Tables):
    return t.evidence.select("signal_id").distinct().join(t.signals.where("review_status <> 'rejected'").select(F.col("id").alias("signal_id")), "signal_id", "left_anti")


@query("f01_recent_signals", sql(f"SELECT id, node_type FROM (SELECT *, row_number() OVER (PARTITION BY node_type ORDER BY extracted_at DESC, id) AS place FROM signals WHERE {VISIBLE}) WHERE place <= 20 ORDER BY heat DESC, extracted_at DESC, id LIMIT 50", "signals"))
def f01(t: Tables):
    rows = filters.top_per(t.signals.where(filters.visible(d.now())), ["node_type"], [F.desc("extracted_at"), F.col("id")], 20)
    return rows.orderBy(F.desc("heat"), F.desc("extracted_at"), "id").limit(50).select("id", "node_type")


@query("f03_top_stories", sql("SELECT id, headline FROM stories WHERE status = 'live' ORDER BY energy DESC, id LIMIT 10", "stories"))
def f03(t: Tables):
    return t.stories.where("status = 'live'").orderBy(F.desc("energy"), "id").limit(10).select("id", "headline")


@query("f04_top_situations", sql("SELECT id, headline FROM situations ORDER BY temperature DESC, id LIMIT 20", "situations"))
def f04(t: Tables):
    return t.situations.orderBy(F.desc("temperature"), "id").limit(20).select("id", "headline")


@query("f05_top_resources", sql("SELECT id, name, signal_count FROM resources ORDER BY signal_count DESC, id LIMIT 20", "resources"))
def f05(t: Tables):
    return t.resources.orderBy(F.desc("signal_count"), "id").limit(20).select("id", "name", "signal_count")


@query("f06_stories_by_tag", sql("SELECT DISTINCT id, energy FROM stories JOIN contains ON story_id = id JOIN tagged USING (signal_id) WHERE tag = '1-URGENT' ORDER BY energy DESC, id LIMIT 20", "stories", "contains", "tagged"))
def f06(t: Tables):
    of = t.contains.join(t.tagged.where("tag = '1-URGENT'"), "signal_id", "left_semi").select(F.col("story_id").alias("id"))
    return t.stories.join(of, "id", "left_semi").orderBy(F.desc("energy"), "id").limit(20).select("id", "energy")


@query("f07_issues_newest", sql("SELECT id, kind, severity FROM issues WHERE status = 'open' ORDER BY created_at DESC, id LIMIT 100", "issues"))
def f07(t: Tables):
    return t.issues.where("status = 'open'").orderBy(F.desc("created_at"), "id").limit(100).select("id", "kind", "severity")


@query("g04_hub_in_story", sql("SELECT tension_id, story_id, count(*) * 1.0 / max(size) AS share FROM (SELECT tension_id, signal_id, count(*) OVER (PARTITION BY tension_id) AS size FROM responds_to) h JOIN contains USING (signal_id) GROUP BY 1, 2 HAVING count(*) * 1.0 / max(size) >= 0.5", "responds_to", "contains"))
def g04(t: Tables):
    size = t.responds_to.groupBy("tension_id").agg(F.count("*").alias("size"))
    both = t.responds_to.join(t.contains, "signal_id").groupBy("tension_id", "story_id").agg(F.count("*").alias("both"))
    return both.join(size, "tension_id").select("tension_id", "story_id", (F.col("both") / F.col("size")).alias("share")).where("share >= 0.5")


@query("g05_jaccard_queries", f"SELECT a.item_id AS a, b.item_id AS b, {r6('len(list_intersect(a.w, b.w)) * 1.0 / len(list_distinct(list_concat(a.w, b.w)))')} AS jaccard FROM (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM benchmark) a JOIN (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM benchmark) b ON a.item_id < b.item_id WHERE len(list_intersect(a.w, b.w)) * 1.0 / len(list_distinct(list_concat(a.w, b.w))) > 0.2")
def g05(t: Tables):
    from ..operators.similar import similar_sets

    return similar_sets(t.benchmark.select(F.col("item_id").alias("id"), "text"), 0.2).select("a", "b", rounded(F.col("jaccard")).alias("jaccard"))


@query("g06_new_urls", sql("SELECT DISTINCT value FROM sources WHERE value NOT IN (SELECT 'https://' || split_part(source_url, '/', 3) || '/' FROM evidence)", "sources", "evidence"))
def g06(t: Tables):
    known = t.evidence.select(F.concat(F.lit("https://"), u.domain(F.col("source_url")), F.lit("/")).alias("value")).distinct()
    return t.sources.select("value").distinct().join(known, "value", "left_anti")
