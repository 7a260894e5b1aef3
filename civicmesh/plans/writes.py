"""Writes as table rewrites, consume-once queues, archive sinks and crawls (A, E, G, J, K and N of the inventory)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from .. import domain as d
from ..checkpoints import new_folder
from ..domain import NOW, r6, rounded, sql
from ..functions import scoring as s
from ..functions import text as x
from ..operators import filters, graph, similar
from ..sources import archive, crawl, runlog
from ..streaming.operators import supervisor_window
from .registry import Tables, query
from .retrieval import BOX, IN_BOX
from .vectors import cos


@query(
    "j01_create_signals",
    sql(
        """
        SELECT id, node_type, title, review_status, starts_at IS NOT NULL AS dated FROM signals WHERE id % 2 = 0
        UNION ALL
        SELECT id + 1000000, node_type, trim(title), 'staged', starts_at IS NOT NULL AND node_type = 'Gathering' FROM signals WHERE id % 3 = 0
        """,
        "signals",
    ),
)
def j01(t: Tables):
    """New signals after known ones: staged whatever their status says, with dates for gatherings only."""
    known = t.signals.where("id % 2 = 0")
    rows = t.signals.where("id % 3 = 0").withColumn("id", F.col("id") + 1_000_000).withColumn("title", F.trim("title"))
    out = known.unionByName(graph.staged(rows, {"Gathering": ["starts_at", "ends_at"]}))
    return out.select("id", "node_type", "title", "review_status", F.col("starts_at").isNotNull().alias("dated"))


@query(
    "j08_story_writes",
    sql(
        """
        , changed AS (SELECT id, headline || ' again' AS headline, 'growing' AS arc FROM stories WHERE id % 3 = 0
                      UNION ALL SELECT id + 100, 'new ' || headline, 'emerging' FROM stories WHERE id % 10 = 0),
        kept AS (SELECT * FROM stories WHERE id % 12 <> 5),
        links AS (SELECT story_id, signal_id FROM contains WHERE story_id % 12 <> 5 AND story_id % 4 <> 1
                  UNION SELECT signal_id % 25, signal_id FROM evidences WHERE (signal_id % 25) % 4 = 1 AND (signal_id % 25) % 12 <> 5)
        SELECT coalesce(k.id, c.id) AS id, coalesce(c.headline, k.headline) AS headline, coalesce(c.arc, k.arc) AS arc, k.energy AS energy,
               (SELECT count(*) FROM links l WHERE l.story_id = coalesce(k.id, c.id)) AS signals
        FROM kept k FULL JOIN changed c ON c.id = k.id WHERE k.id IS NOT NULL OR c.id >= 100
        """,
        "stories", "contains", "evidences",
    ),
)
def j08(t: Tables):
    """Stories created, updated and archived with their edges; the signals of one in four are cleared and linked anew."""
    i = F.col("id")
    gone = t.stories.where(i % 12 == 5).select("id")
    changed = t.stories.where(i % 3 == 0).join(gone, "id", "left_anti").select("id", F.concat("headline", F.lit(" again")).alias("headline"), F.lit("growing").alias("arc"))
    new = t.stories.where(i % 10 == 0).select((i + 100).alias("id"), F.concat(F.lit("new "), "headline").alias("headline"), F.lit("emerging").alias("arc"))
    kept = t.stories.join(gone, "id", "left_anti").select("id", "headline", "arc", "energy")
    stories = graph.upserted(kept, changed.unionByName(new).withColumn("energy", F.lit(None).cast("double")), ["id"], ["headline", "arc"])
    cleared = t.stories.where(i % 4 == 1).select(i.alias("story_id"))
    again = t.evidences.select((F.col("signal_id") % 25).alias("story_id"), "signal_id").join(cleared, "story_id", "left_semi")
    links = graph.relinked(t.contains, again, "story_id", cleared).join(gone.withColumnRenamed("id", "story_id"), "story_id", "left_anti")
    counts = links.groupBy(F.col("story_id").alias("id")).agg(F.count("*").alias("signals"))
    return stories.join(counts, "id", "left").select("id", "headline", "arc", "energy", F.coalesce("signals", F.lit(0)).alias("signals"))


@query(
    "j08_story_snapshots",
    sql(
        """
        SELECT story_id, count(DISTINCT signal_id) AS signals, count(DISTINCT source) AS entities,
               count(*) FILTER (WHERE node_type = 'Need') AS asks, count(*) FILTER (WHERE node_type = 'Aid') AS gives
        FROM contains JOIN signals ON id = signal_id GROUP BY 1
        """,
        "contains", "signals",
    ),
)
def j08s(t: Tables):
    rows = t.contains.join(t.signals.select(F.col("id").alias("signal_id"), "source", "node_type"), "signal_id")
    kind = lambda k: F.count(F.when(F.col("node_type") == k, 1))
    return rows.groupBy("story_id").agg(F.count("*").alias("signals"), F.countDistinct("source").alias("entities"), kind("Need").alias("asks"), kind("Aid").alias("gives"))


@query(
    "j14_situation_writes",
    sql(
        """
        , n AS (SELECT situation_id AS id, count(*) AS n, max(created_at) AS latest FROM dispatches GROUP BY 1)
        SELECT s.id, coalesce(n, 0) AS dispatches, CAST(floor(epoch(greatest(last_updated, coalesce(latest, last_updated)))) AS BIGINT) AS updated,
               CASE WHEN s.id % 5 = 0 THEN least(temperature + 0.1, 1.0) ELSE temperature END AS temperature
        FROM situations s LEFT JOIN n ON n.id = s.id
        """,
        "situations", "dispatches",
    ),
)
def j14(t: Tables):
    """Dispatches appended: their situation's count and time follow; temperatures that were computed anew are taken over."""
    n = t.dispatches.groupBy(F.col("situation_id").alias("id")).agg(F.count("*").alias("dispatches"), F.max("created_at").alias("at"))
    fresh = t.situations.where("id % 5 = 0").select("id", F.least(F.col("temperature") + 0.1, F.lit(1.0)).alias("temperature"))
    rows = graph.upserted(t.situations.select("id", "last_updated", "temperature"), fresh.withColumn("last_updated", F.lit(None).cast("timestamp_ntz")), ["id"], ["temperature"])
    rows = rows.join(n, "id", "left").withColumn("last_updated", F.greatest("last_updated", "at"))
    return rows.select("id", F.coalesce("dispatches", F.lit(0)).alias("dispatches"), F.unix_seconds(F.col("last_updated").cast("timestamp")).alias("updated"), "temperature")


@query(
    "j14_dispatch_positions",
    sql("SELECT id, situation_id, row_number() OVER (PARTITION BY situation_id ORDER BY created_at, id) - 1 AS position FROM dispatches", "dispatches"),
)
def j14p(t: Tables):
    position = F.row_number().over(filters.Window.partitionBy("situation_id").orderBy("created_at", "id")).cast("long") - 1
    return t.dispatches.select("id", "situation_id", position.alias("position"))


@query("k06_pins_consumed", sql(f"SELECT id FROM pins WHERE NOT ({IN_BOX} AND source_id IN (SELECT id FROM sources WHERE active))", "pins", "sources"))
def k06(t: Tables):
    """Pins that stay after a run used those in its region whose source is active."""
    used = filters.inside(t.pins, BOX).join(t.sources.where("active").select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return graph.consumed(t.pins, used, "id")[1].select("id")


@query(
    "k06_demand_consumed",
    sql(f"SELECT query, count(*) AS n FROM demands WHERE created_at > {NOW} - INTERVAL 1 DAY GROUP BY 1 HAVING count(*) >= 2", "demands"),
)
def k06d(t: Tables):
    """What was asked for twice or more in the last day becomes a task; these demands are then used up."""
    recent = t.demands.where(F.col("created_at") > F.timestamp_add("DAY", F.lit(-1), d.now()))
    used, _ = graph.consumed(t.demands, recent, "id")
    return used.groupBy("query").agg(F.count("*").alias("n")).where("n >= 2")


@query(
    "n12_task_upserts",
    sql(
        """
        SELECT id, CASE WHEN id % 24 = 0 THEN 'pending' WHEN id % 40 = 0 AND status = 'pending' THEN 'running' ELSE status END AS status FROM tasks
        UNION ALL SELECT -source_id - 1, 'pending' FROM (SELECT DISTINCT source_id FROM pins)
        """,
        "tasks", "pins",
    ),
)
def n12(t: Tables):
    """Tasks reset, started if they wait, and made from pins, one for each source."""
    status = F.when(F.col("id") % 24 == 0, "pending").when((F.col("id") % 40 == 0) & (F.col("status") == "pending"), "running").otherwise(F.col("status"))
    made = t.pins.select((-F.col("source_id") - 1).alias("id"), F.lit("pending").alias("status"))
    return graph.upserted(t.tasks.select("id", status.alias("status")), made, ["id"], ["status"])


@query(
    "n14_pending_candidates",
    sql(
        """
        SELECT s.id, situation_id FROM evidences e JOIN signals s ON s.id = e.signal_id JOIN situations t ON t.id = e.situation_id
        WHERE NOT debunked AND match_confidence < 0.3 AND arc <> 'cold'
        """,
        "evidences", "signals", "situations",
    ),
)
def n14(t: Tables):
    """Assignments that are weak and wait for another look, of situations that are not cold."""
    weak = t.evidences.where("not debunked and match_confidence < 0.3").join(t.situations.where("arc <> 'cold'").select(F.col("id").alias("situation_id")), "situation_id")
    return weak.join(t.signals.select(F.col("id").alias("signal_id")), "signal_id").select(F.col("signal_id").alias("id"), "situation_id")


@query(
    "n16_finder_links",
    sql(
        f"""
        , q AS (SELECT id, embedding FROM signal_vectors),
        near AS (SELECT q.id, v.id AS other, {cos("q.embedding", "v.embedding")} AS c FROM q JOIN signal_vectors v ON v.id <> q.id JOIN signals s ON s.id = v.id),
        best AS (SELECT id, arg_max(other, (c, -other)) AS other, max(c) AS c FROM near WHERE c >= 0.35 GROUP BY 1)
        SELECT q.id, other AS linked, other IS NULL AS created, {r6("coalesce(c, 1)")} AS strength FROM q LEFT JOIN best USING (id)
        """,
        "signal_vectors", "signals",
    ),
)
def n16(t: Tables):
    """What a finder found: linked to the nearest known signal if that is near enough, else created."""
    found = t.signal_vectors
    known = t.signals.select("id").join(t.signal_vectors, "id")
    best = similar.nearest_each(found, known, 1, 0.35).select(F.col("a").alias("id"), F.col("b").alias("linked"), "cosine")
    rows = found.select("id").join(best, "id", "left")
    return rows.select("id", "linked", F.col("linked").isNull().alias("created"), rounded(F.coalesce("cosine", F.lit(1.0))).alias("strength"))


@query(
    "l27_situation_weaving",
    sql(
        f"""
        , free AS (SELECT s.id, s.heat, v.embedding FROM signals s JOIN signal_vectors v USING (id)
                   WHERE review_status = 'live' AND s.id NOT IN (SELECT signal_id FROM evidences)),
        near AS (SELECT f.id, v.id AS situation_id, {cos("f.embedding", "v.embedding")} AS c, t.arc FROM free f JOIN signal_vectors v ON v.id <> f.id JOIN situations t ON t.id = v.id),
        best AS (SELECT id, arg_max(situation_id, (c, -situation_id)) AS situation_id, max(c) AS c FROM near WHERE c >= CASE arc WHEN 'cold' THEN 0.35 ELSE 0.3 END GROUP BY 1)
        SELECT situation_id, count(*) AS joined, {r6("max(c)")} AS best FROM best GROUP BY 1
        """,
        "signals", "signal_vectors", "evidences", "situations",
    ),
)
def l27(t: Tables):
    """The weaving without a model: signals in no situation go to the nearest one, with a higher bar for cold ones."""
    free = t.signals.where("review_status = 'live'").join(t.evidences.select(F.col("signal_id").alias("id")).distinct(), "id", "left_anti").select("id").join(t.signal_vectors, "id")
    found = None
    for cold, bar in ((False, 0.3), (True, 0.35)):
        of = t.situations.where((F.col("arc") == "cold") == cold).select("id").join(t.signal_vectors, "id")
        one = similar.similar_pairs(free, bar, of, best=1)
        found = one if found is None else found.unionByName(one)
    best = filters.top_per(found, ["a"], [F.desc("cosine"), F.col("b")], 1)
    return best.groupBy(F.col("b").alias("situation_id")).agg(F.count("*").alias("joined"), rounded(F.max("cosine")).alias("best"))


@query(
    "b14_scored_signals",
    sql("SELECT id, CASE sensitivity WHEN 'general' THEN 1.0 WHEN 'elevated' THEN 0.7 ELSE 0.3 END * 0.5 + 0.25 AS confidence FROM signals WHERE id % 9 <> 0", "signals"),
)
def b14(t: Tables):
    """Extracted nodes get their confidence from completeness and accuracy; evidence nodes are no signals."""
    kind = F.when(F.col("id") % 9 == 0, "Evidence").otherwise(F.col("node_type"))
    accuracy = F.when(F.col("sensitivity") == "general", "high").when(F.col("sensitivity") == "elevated", "medium").otherwise("low")
    return t.signals.where(kind != "Evidence").select("id", s.extraction_confidence(F.lit(0.5), accuracy).alias("confidence"))


@query("e07_event_numbers", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS seq FROM events")
def e07(t: Tables):
    return runlog.numbered(t.events.select("user_id", "ts", "event_id"), "user_id", "ts", "event_id").select("event_id", "seq")


def _archived(t: Tables):
    at = F.lit("2024-03-01 00:00:00").cast("timestamp")
    rows = t.pages.select(F.col("page_id").cast("string").alias("id"), (F.col("page_id") % 7).cast("string").alias("source_id"), F.sha2("html", 256).alias("content_hash"), at.alias("fetched_at"), x.title(F.col("html")).alias("title"))
    return rows.where("title <> ''")


TITLE = "trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"


@query("a09_archive_pages", f"SELECT CAST(page_id AS VARCHAR) AS id, CAST(page_id % 7 AS VARCHAR) AS source_id, {TITLE} AS title FROM pages WHERE {TITLE} <> ''")
def a09(t: Tables):
    """Pages appended to the archive and read from it."""
    root = new_folder(t.spark, "archive")
    rows = _archived(t)
    for part in (rows.where("source_id < '3'"), rows.where("source_id >= '3'")):
        archive.append(part, root, "pages")
    return archive.read(t.spark, root, "pages").select("id", "source_id", "title")


@query("a17_report", sql("SELECT id, review_status FROM signals WHERE review_status = 'rejected'", "signals"))
def a17(t: Tables):
    """Rejected signals as a report of JSON lines."""
    path = new_folder(t.spark, "report")
    archive.report(t.signals.where("review_status = 'rejected'").select("id", "review_status"), path)
    return t.spark.read.schema("id long, review_status string").json(path)


@query(
    "g02_all_content",
    """
    SELECT kind, count(*) AS n FROM (
        SELECT 'pages' AS kind FROM pages UNION ALL SELECT 'posts' FROM conversations UNION ALL SELECT 'files' FROM part UNION ALL SELECT 'feeds' FROM supplier) GROUP BY 1
    """,
)
def g02(t: Tables):
    """All content types as one table of their common columns."""
    parts = {"pages": (t.pages, "page_id"), "posts": (t.conversations, "conv_id"), "files": (t.part, "p_partkey"), "feeds": (t.supplier, "s_suppkey")}
    return archive.everything({kind: df.select(F.col(key).cast("string").alias("id")) for kind, (df, key) in parts.items()}).groupBy("kind").agg(F.count("*").alias("n"))


@query("j22_archive_upsert", f"SELECT min(CAST(page_id AS BIGINT)) AS id, sha256(html) AS content_hash FROM pages WHERE {TITLE} <> '' AND sha256(html) NOT IN (SELECT sha256(html) FROM pages WHERE page_id % 3 = 0 AND {TITLE} <> '') GROUP BY 2")
def j22(t: Tables):
    """Contents that the archive does not have, each once."""
    rows = _archived(t).withColumn("id", F.col("id").cast("long"))
    first = rows.groupBy("content_hash").agg(F.min("id").alias("id"))
    return archive.unseen(first, rows.where("id % 3 = 0"), ("content_hash",)).select("id", "content_hash")


LINKS = """
    SELECT 'https://site' || (page_id % 3) || '.org/p/' || page_id AS url, 'https://site' || ((page_id * k + 1) % n % 3) || '.org/p/' || ((page_id * k + 1) % n) AS target
    FROM pages, (SELECT count(*) AS n FROM pages), (VALUES (2), (3), (4)) v(k)
"""


@query(
    "a12_crawl",
    f"""
    WITH RECURSIVE links AS ({LINKS}),
    e AS (SELECT DISTINCT * FROM links WHERE split_part(url, '/', 3) = split_part(target, '/', 3) AND NOT regexp_matches(target, '/p/[0-9]*9$')),
    r AS (
        SELECT 'https://site0.org/p/0' AS url, 0 AS level UNION ALL SELECT 'https://site1.org/p/1', 0
        UNION SELECT e.target, r.level + 1 FROM r JOIN e ON e.url = r.url WHERE r.level < 5)
    SELECT url, CAST(min(level) AS INTEGER) AS level FROM r GROUP BY 1 ORDER BY 2, 1 LIMIT 60
    """,
)
def a12(t: Tables):
    """Pages within five links of two seeds on their hosts, breadth first, at most sixty."""
    n, i = t.pages.count(), F.col("page_id")
    page = lambda p: F.concat(F.lit("https://site"), (p % 3).cast("string"), F.lit(".org/p/"), p.cast("string"))
    links = t.pages.select(page(i).alias("url"), F.explode(F.array(*(page((i * k + 1) % n) for k in (2, 3, 4)))).alias("target"))
    seeds = t.spark.createDataFrame([("https://site0.org/p/0",), ("https://site1.org/p/1",)], "url string")
    return crawl.crawl(seeds, links, 5, 60, exclude=["/p/[0-9]*9$"]).select("url", "level")


@query("k02_examined_window", sql("SELECT id FROM signals WHERE extracted_at >= TIMESTAMP '2024-03-10 12:00:00' AND extracted_at < TIMESTAMP '2024-03-11 12:00:00'", "signals"))
def k02(t: Tables):
    """What a run after the last one of March 10 examines: a day; what came before its start is late and stays out."""
    start, end = supervisor_window(datetime(2024, 3, 10, 12), datetime(2024, 5, 1))
    return t.signals.where((F.col("extracted_at") >= F.lit(str(start)).cast("timestamp_ntz")) & (F.col("extracted_at") < F.lit(str(end)).cast("timestamp_ntz"))).select("id")
