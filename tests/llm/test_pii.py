import contextlib
import hashlib
import io
import random
import re

import numpy as np

from civicmesh.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))
    return sum(v - 9 * (v > 9) for v in doubled) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))) or (kind == "card" and 16 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 8 <= len(digits) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def told(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def compare(spark, texts):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, base string, candidates string")
    got = {r["doc_id"]: r for r in pii.personal_data(df).collect()}
    assert set(got) == set(range(len(texts)))
    added = {}
    for i, text in enumerate(texts):
        base = plain(text or "")
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(told(base).encode()).hexdigest(), (text or "")[:200]
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in base) for k in PLAIN]
        every = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        order = list(PLAIN)
        assert every == sorted(every, key=lambda s: (order.index(s[0]), s[1], s[2])) and set(base) <= set(every)
        added[i] = [f"{k}:{a}:{b}" for k, a, b in every if (k, a, b) not in set(base)] if len(every) > len(base) else []
    return added


PIECES = ["a", "Bc9", "@", "@", ".", ".", "..", "-", " ", " ", "é", "😀", "1", "12", "255", "256", "007", "+1", "+", "(", ")", "4539578763621486", "x.y", "%", "\n", "", "", "192.168.1.1", "a@b.c", "(at)", "\x00"]


def test_base_spans_of_odd_texts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    texts += [None, "", " ", "a@b.c%d@e.f", "a@b.cd@e.f.g@h.i", "1.2.3.4.5.6.7.8", "1.2.3", "00000000255.1.1.1", "1234567890123456 99", "a@b.c"]
    compare(spark, texts)


def test_very_long_runs(spark):
    long = 2_000  # the plain patterns take quadratic time
    compare(spark, ["7" * long, "1 " * long, "a" * long + "@b.c", "a." * long, "1." * long, "+1" + "(" * long + "22222222", "a@b" + ".c" * long, "é" * long + " 10.1.2.3 x@y.zz"])
    runs = spark.createDataFrame([(0, "7" * 200_000), (1, "a." * 100_000), (2, "a" * 200_000 + "@b.c")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["spans"]) for r in pii.personal_data(runs).collect()) == [(0, ""), (1, ""), (2, "email:0:200004")]
    many = compare(spark, [" ".join(f"u{i}@h{i}.com 10.0.{i % 256}.7" for i in range(3000)), "x"])
    assert many[0] == []


def test_spans_that_the_model_adds(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeg") for _ in range(5))

    def card(real):
        while True:
            c = "4" + "".join(rng.choice("0123456789") for _ in range(15))
            if luhn(c) == real:
                return c

    texts = []
    for _ in range(120):
        texts.append(f"{word()} +1 (555) 555-{rng.randrange(1000, 9999)} {word()} {card(True)} {word()}, {word()}@{word()}.com {word()} 23.45.67.{rng.randrange(10, 250)} {word()}")
        texts.append(f"{word()} {card(False)} {word()} {word()} version 300.400.500.600 {word()} 3.2 {word()}")
    lost = f"{word()} +1 (555) 555-2186 {card(True)} and on"  # one match of 27 digits: no base span
    hidden = f"{word()} {word()}(at){word()}.com {word()}"
    clean = f"{word()} costs 12 500 or 3.5, see {word()} {card(False)}"
    added = compare(spark, [*texts, lost, hidden, clean])
    n = len(texts)
    start = lost.index("+1")
    assert plain(lost) == [] and added[n] == [f"card:{start + 18}:{start + 34}", f"phone:{start}:{start + 17}"]
    assert [s.split(":")[0] for s in added[n + 1]] == ["email"]
    assert added[n + 2] == [] and all(not added[i] for i in range(n))


def test_reliabilities_against_known_labelers():
    rng = np.random.default_rng(2)
    n, truth = 20_000, rng.random(20_000) < 0.4
    right = [0.95, 0.8, 0.7, 0.9, 0.6]
    votes = np.stack([np.where(rng.random(n) < a, truth, ~truth).astype(int) for a in right], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, table, prior = pii.reliabilities(np.zeros(len(patterns), int), patterns, counts.astype(float))  # kind 0 has no fixed row
    assert abs(prior[0] - 0.4) < 0.03
    for i, a in enumerate(right):
        assert abs(table[0, i, 1, pii.YES] - a) < 0.03 and abs(table[0, i, 0, pii.NO] - a) < 0.03


def test_only_builtin_expressions(spark):
    df = spark.sql("SELECT 1L AS doc_id, 'call +1 (555) 555-1234 or a@b.com' AS text")
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        pii.personal_data(df).explain("formatted")
        df.select(pii.candidates(df.text), *(pii.base_spans(df.text, k) for k in pii.KINDS)).explain("formatted")
    assert not re.search("Python|Arrow|Pandas", out.getvalue())


def test_empty_tables_and_repeated_rows(spark):
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    out = pii.personal_data(spark.createDataFrame([(None, "a@b.c"), (1, "a@b.c"), (1, "a@b.c")], "doc_id long, text string")).collect()
    assert [(r["n_email"], r["spans"]) for r in out] == [(1, "email:0:5")] * 3
