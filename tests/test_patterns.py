import contextlib
import io
import random

from civicmesh.operators import filters, patterns


def made(seed, texts, many):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdeé/.") for _ in range(n))
    return [word(rng.randrange(0, 60)) for _ in range(texts)], [word(rng.randrange(3, 8)) for _ in range(many)]


def test_ten_thousand_patterns(spark):
    texts, many = made(1, 300, 10_000)
    urls = spark.createDataFrame([*enumerate(texts), (900, None)], "id long, url string")
    listed = spark.createDataFrame([*((p,) for p in many), (None,)], "pattern string")
    df = filters.blocked(urls, listed)
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    assert "NestedLoop" not in out.getvalue() and "Cartesian" not in out.getvalue()
    assert {r.id for r in df.collect()} == {i for i, t in enumerate(texts) if any(p in t for p in many)}
    assert df.columns == ["id", "url"]


def test_patterns_in_parts_and_every_match(spark, monkeypatch):
    monkeypatch.setattr(patterns, "PART_BYTES", 200)
    texts, many = made(2, 80, 120)
    many += ["a", "aa", "é"]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, pattern int")
    listed = spark.createDataFrame([(p,) for p in many], "p string")
    assert len(list(patterns._parts(listed, "p"))) > 2
    got = sorted((r.text, r.pattern) for r in patterns.matches(df, listed, "text", "p").collect())
    assert got == sorted((t, p) for t in texts for p in set(many) if p in t)
    kept = patterns.containing(df, listed, "text", "p")
    assert kept.columns == ["text", "pattern"] and sorted(r.text for r in kept.collect()) == sorted(t for t in texts if any(p in t for p in many))


def test_empty_patterns_and_tables(spark):
    df = spark.createDataFrame([("x",), ("",), (None,)], "text string")
    none, blank = spark.createDataFrame([], "pattern string"), spark.createDataFrame([("",)], "pattern string")
    assert patterns.containing(df, none).count() == 0 and patterns.matches(df, none).count() == 0
    assert sorted(r.text for r in patterns.containing(df, blank).collect()) == ["", "x"]
    assert patterns.containing(df.limit(0), blank).count() == 0
