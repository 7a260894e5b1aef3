import duckdb
import pytest
from pyspark.sql import functions as F

from civicmesh.functions import geo, replies, scoring, text, url


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x)


def fnv1a(data: bytes) -> str:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return f"{h:x}"


def test_content_hash(spark):
    texts = ["", "a", "hello world", "Größe ✓", "x" * 300]
    rows = spark.createDataFrame([(s,) for s in texts], "s string").select("s", text.content_hash(F.col("s")).alias("h")).collect()
    assert {r.s: r.h for r in rows} == {s: fnv1a(s.encode()) for s in texts}


@pytest.mark.parametrize(
    "value, canonical, strategy, channel",
    [
        ("mutual aid", "mutual aid", "web_query", "press"),
        ("https://www.instagram.com/foo/", "instagram.com/foo", "social", "social"),
        ("https://www.reddit.com/r/Minneapolis/top", "reddit.com/r/Minneapolis", "social", "social"),
        ("https://www.tiktok.com/@bar", "tiktok.com/bar", "social", "social"),
        ("https://twitter.com/@baz/", "x.com/baz", "social", "social"),
        ("https://www.eventbrite.com/d/mn/events", "https://www.eventbrite.com/d/mn/events", "html_listing", "direct_action"),
        ("https://example.org/news/feed", "https://example.org/news/feed", "rss", "community_media"),
        ("https://example.org/about", "https://example.org/about", "web_page", "press"),
    ],
)
def test_urls(spark, value, canonical, strategy, channel):
    assert one(spark, F.struct(url.canonical(lit(value)), url.strategy(lit(value)), url.channel(lit(value)))) == (canonical, strategy, channel)


@pytest.mark.parametrize(
    "value, expected",
    [
        ("https://a.org/x?utm_source=b&id=1#f", "https://a.org/x?id=1#f"),
        ("https://a.org/x?ref=b", "https://a.org/x"),
        ("a.org/x", "https://a.org/x"),
        ("https://a.org/x", "https://a.org/x"),
    ],
)
def test_sanitized(spark, value, expected):
    assert one(spark, url.sanitized(lit(value))) == expected


def test_normalized_and_export(spark):
    assert one(spark, url.normalized(lit("https://www.twitter.com/a//"))) == "x.com/a"
    assert one(spark, url.export_link(lit("https://docs.google.com/document/d/abc/edit?x=1"))) == "https://docs.google.com/document/d/abc/export?format=txt"


def test_pii_mentions_claims(spark):
    s = "Call 612-555-0199 or mail a.b@c.org, 123 Main St. SSN 123-45-6789. Hi @Jörg and #Größe #größe"
    assert one(spark, text.pii(lit(s))) == ["phone number detected", "email address detected", "SSN pattern detected", "street address detected"]
    assert one(spark, text.mentions(lit("Hi @Jörg @jörg"))) == ["jörg"]
    assert one(spark, text.hashtags(lit(s))) == ["größe"]
    assert one(spark, text.uncited_claim(lit("The council met on Tuesday at noon."))) is True
    assert one(spark, text.uncited_claim(lit("they met at noon today."))) is False
    assert one(spark, text.uncited_claim(lit("The council met on Tuesday [signal:00000000-0000-0000-0000-000000000000]."))) is False


def test_og_tags_in_both_orders(spark):
    a = '<meta property="og:title" content="A">'
    b = '<meta content="B" property="og:title">'
    assert one(spark, text.preview_title(lit(a))) == "A"
    assert one(spark, text.preview_title(lit(b))) == "B"
    assert one(spark, text.preview_title(lit("<title> C </title>"))) == "C"
    assert one(spark, text.preview_title(lit("nothing"))) is None


def test_geohash_and_distance(spark):
    assert one(spark, geo.geohash(lit(57.64911), lit(10.40744), 11)) == "u4pruydqqvj"
    assert one(spark, geo.geohash(lit(90.0), lit(180.0), 5)) == "zzzzz"
    assert one(spark, geo.haversine_km(lit(44.98), lit(-93.27), lit(44.95), lit(-93.09))) == pytest.approx(14.54, abs=0.05)


def test_fuzzing_keeps_general_places(spark):
    row = one(spark, F.struct(*(geo.snapped(lit(44.9778), lit(s)) for s in ("general", "elevated", "sensitive"))))
    assert [round(x, 6) for x in row] == [44.9778, 44.98, 45.0]


@pytest.mark.parametrize("args, expected", [((1, 5, 5), "echo"), ((2, 2, 5), "confirmed"), ((1, 3, 4), "emerging"), ((2, 1, 9), "emerging")])
def test_story_status(spark, args, expected):
    assert one(spark, scoring.story_status(*map(lit, args))) == expected


@pytest.mark.parametrize("args, expected", [((0.1, 3.0, True), "resurgent"), ((0.0, 3.0, True), "emerging"), ((0.6, 9.0, False), "growing"), ((-0.3, 9.0, False), "fading"), ((-0.29, 9.0, False), "stable"), ((0.5, 7.0, False), "stable")])
def test_story_arc(spark, args, expected):
    assert one(spark, scoring.story_arc(*map(lit, args))) == expected


@pytest.mark.parametrize(
    "args, expected",
    [((0.3, 500, "cold"), "developing"), ((0.29, 500, "cold"), "cooling"), ((0.09, 1, "active"), "cold"), ((0.1, 1, "active"), "cooling"), ((0.3, 71, "active"), "emerging"), ((0.59, 72, "active"), "developing"), ((0.6, 72, "active"), "active")],
)
def test_situation_arc(spark, args, expected):
    assert one(spark, scoring.situation_arc(*map(lit, args))) == expected


@pytest.mark.parametrize("args, expected", [((0.9, 0, "curated"), 6), ((0.9, 2, "curated"), 12), ((0.2, 4, "curated"), 1344), ((0.9, 5, "curated"), None), ((0.9, 3, "linked_from"), None), ((0.51, 1, "linked_from"), 24)])
def test_cadence(spark, args, expected):
    assert one(spark, scoring.cadence_with_backoff(*map(lit, args))) == expected


def test_source_weight_bounds(spark):
    w = lambda *a: one(spark, scoring.source_weight(*map(lit, a)))
    assert w(0, 0, 0, 0, None) == pytest.approx(0.3 * 0.7)
    assert w(10, 10, 10, 10, 0) == 1.0
    assert w(0, 0, 50, 0, 400) == 0.1


def test_energy_ignores_channels_of_echoes(spark):
    base = [lit(0.0), lit(0.0), lit(5), lit(1), lit(4)]
    assert one(spark, scoring.story_energy(*base, lit("echo"))) == pytest.approx(0.1 + 0.04)
    assert one(spark, scoring.story_energy(*base, lit("emerging"))) == pytest.approx(0.1 + 0.04 + 0.1)


def test_jaccard_of_empty_sets(spark):
    e = text.words(lit(""))
    assert one(spark, text.jaccard(e, e)) == 0.0
    assert one(spark, text.jaccard(text.words(lit("a b c")), text.words(lit("b c d")))) == 0.5
    assert duckdb.sql("select 1").fetchall() == [(1,)]


def test_uncited_claims_look_at_every_word(spark):
    texts = ["one " + "word " * n + "Berlin" for n in (3, 1500, 20000)] + ["Berlin " + "word " * 1500, "One two", ""]
    rows = spark.createDataFrame([*enumerate(texts)], "i long, s string").select("i", text.uncited_claim(F.col("s")).alias("x")).collect()
    assert [r.x for r in sorted(rows)] == [True, True, True, False, False, False]


def test_owned_sources_follow_the_strategy(spark):
    own = ["https://www.instagram.com/a", "https://m.facebook.com/a", "https://old.reddit.com/r/a", "http://WWW.X.com/a", "https://mobile.twitter.com/a", "https://bsky.app/profile/a"]
    not_own = ["https://example.org/", "https://example.org/feed", "instagram.com/a", "some words", ""]
    df = spark.createDataFrame([(v,) for v in [*own, *not_own, None]], "v string")
    got = {r.v: r.o for r in df.select("v", url.owned(F.col("v")).alias("o")).collect()}
    assert [got[v] for v in own] == [True] * len(own) and [got[v] for v in not_own] == [False] * len(not_own) and not got[None]


def test_loose_arrays_in_replies(spark):
    cases = {
        '{"s": [{"k": 1}, {"k": null}]}': [1, None], '{"s": "[{\\"k\\": 2}]"}': [2], '{"s": " [] "}': [], '{"s": null}': [], "{}": [],
        '{"s": {"k": 1}}': None, '{"s": 5}': None, '{"s": "null"}': None, '{"s": "[{"}': None, "no reply": None, "": None, None: None,
    }
    df = spark.createDataFrame([(i, r) for i, r in enumerate(cases)], "i int, r string")
    got = {r.i: None if r.s is None else [x.k for x in r.s] for r in df.select("i", replies.listed(F.col("r"), "s", "struct<k: bigint>").alias("s")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
