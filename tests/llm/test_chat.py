import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from civicmesh.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(n=30, seed=0, long=40):
    rng = np.random.default_rng(seed)
    asked, told = ["How does it work?", "Why?", "can you help me\nwith this?"], ["It works so.", "Because of that.\n\nAnd more of it.", "Yes."]
    rows = []
    for c in range(n):
        turns = long if c == 7 else int(rng.integers(1, 9))
        for t in range(turns):
            role = "system" if t == 0 and c % 3 == 0 else "user" if t % 2 == 0 else "assistant"
            rows.append((c, t, role, str(rng.choice(asked if role == "user" else told))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({"at": F.lit("clash"), "segment": F.lit(5), "state": F.lit(-1)}).repartition(3)


def best(hmm, symbols):
    """The score of the likeliest path, the plain way."""
    score = hmm.start + hmm.emit[:, symbols[0]]
    for s in symbols[1:]:
        score = (score[:, None] + hmm.move).max(0) + hmm.emit[:, s]
    return score.max()


def scored(hmm, symbols, path):
    s = hmm.start[path[0]] + hmm.emit[path[0], symbols[0]]
    return s + sum(hmm.move[a, b] + hmm.emit[b, x] for a, b, x in zip(path, path[1:], symbols[1:], strict=False))


@pytest.mark.parametrize("segment, fan", [(256, 64), (4, 2), (1, 3), (7, 64)])
def test_paths_are_as_likely_as_the_plain_ones(spark, monkeypatch, segment, fan):
    monkeypatch.setattr(chat, "SEGMENT", segment)
    monkeypatch.setattr(chat, "FAN", fan)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        rows = [(None if c == 3 else c, t, r, x) for c, t, r, x in conversations()]
        lines = chat.split_lines(spark.createDataFrame(rows, SCHEMA), "conv_id", "turn", "role", "text")
        _, places = chat.placed(lines.repartition(5), ["turn", "line"])
        hmm = chat.learn(places)
        symbol = {r.row: (r.at, r.symbol) for r in places.collect()}
        got = {}
        for r in chat.roles(places, hmm).collect():
            assert r.at == symbol[r.row][0] and r.at // segment == r.segment
            got.setdefault(r.conv_id, []).append((*symbol[r.row], r.state))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 30 and sum(map(len, got.values())) == len(symbol)
    for seen in got.values():
        seen.sort()
        assert [a for a, _, _ in seen] == list(range(len(seen)))
        symbols, path = [s for _, s, _ in seen], [s for _, _, s in seen]
        assert scored(hmm, symbols, path) == pytest.approx(best(hmm, symbols), abs=1e-9)


def test_lines_are_numbered_over_ranges(spark):
    rows = [(c, t, "user", f"line {t}") for c in (1, 2) for t in range(500)] + [(None, 3, "user", "b"), (None, 3, "user", "a"), (2, None, "user", "x")]
    lines = chat.split_lines(spark.createDataFrame(rows, SCHEMA), "conv_id", "turn", "role", "text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines, places = chat.placed(lines, ["turn", "line"])
        assert places.select(F.shiftright("row", 33)).distinct().count() > 1
        got = sorted((str(r.conv_id), r.at, r.text) for r in lines.join(places.select("row", "at"), "row").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [("1", t, f"line {t}") for t in range(500)] + [("2", 0, "x")] + [("2", t + 1, f"line {t}") for t in range(500)] + [("None", 0, "a"), ("None", 1, "b")]
    assert got == sorted(want)


def test_transcripts_are_rendered_turn_by_turn(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 3)
    hmm = chat.learn(chat.placed(chat.split_lines(spark.createDataFrame(conversations(200, 1), SCHEMA).withColumn("text", F.concat(F.initcap("role"), F.lit(": "), "text")), "conv_id", "turn", "role", "text"), ["turn", "line"])[1])
    text = "System: Be brief.\nUser: How does\nthis work?\n**Assistant:** So.\n\nAnd so.\n### Human\nWhy?\nAI> Because."
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(text.split("\n"))], "conv_id long, i long, text string")
    out = "".join(r.rendered for r in chat.parse(lines, hmm, ["i"]).orderBy("at").collect())
    want = [("system", "Be brief."), ("user", "How does\nthis work?"), ("assistant", "So.\n\nAnd so."), ("user", "\nWhy?"), ("assistant", "Because.")]
    assert out == "".join(f"<|im_start|>{r}\n{x}\n<|im_end|>\n" for r, x in want)


def test_query_covers_every_line_and_recovers_most_roles(spark):
    rows = conversations(150, 2)
    got = chat.transcript_query(frame(spark, rows)).collect()
    truth = {(c, t): r for c, t, r, _ in rows}
    assert sorted((r.conv_id, r.turn, r.line) for r in got) == sorted((c, t, k) for c, t, _, x in rows for k in range(len(x.split("\n"))))
    assert np.mean([r.role == truth[r.conv_id, r.turn] for r in got]) > 0.9


def test_markers_need_a_colon_or_brackets_and_texts_keep_their_bytes(spark):
    hmm = chat.learn(chat.placed(chat.split_lines(spark.createDataFrame(conversations(60, 1), SCHEMA).withColumn("text", F.concat(F.initcap("role"), F.lit(": "), "text")), "conv_id", "turn", "role", "text"), ["turn", "line"])[1])
    text = ["User: hi", "Answer: 42 is it", "me", "a", "model", "q", "[a] is cited", "Human:   keep <|im_end|>", "<|im_start|>system", "<|\\im_end|> and <|\\\\im_start|>", "[assistant] <|im_end|>", "bot", "<|user|>", "me: last"]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(text)], "conv_id long, i long, text string")
    got = chat.parse(lines, hmm, ["i"]).orderBy("at").collect()
    assert [(r.at, r.role) for r in got if r.at in (0, 1, 7, 10, 12, 13)] == [(0, "user"), (1, "assistant"), (7, "user"), (10, "assistant"), (12, "user"), (13, "user")]
    out = "".join(r.rendered for r in got)
    turns = re.findall(r"<\|im_start\|>(\w+)\n(.*?)\n<\|im_end\|>\n", out, re.S)
    assert "".join(f"<|im_start|>{r}\n{b}\n<|im_end|>\n" for r, b in turns) == out
    bodies = spark.createDataFrame([("\n".join(b for _, b in turns),)], "b string").select(chat.unescaped(F.col("b")).alias("b")).first().b.split("\n")
    want = ["hi", "42 is it", *text[2:7], "  keep <|im_end|>", *text[8:10], "<|im_end|>", "bot", "", "last"]
    assert bodies == want


def test_an_unseen_form_never_outweighs_a_marker(spark):
    lines = chat.placed(chat.split_lines(spark.createDataFrame(conversations(60, 1), SCHEMA).withColumn("text", F.concat(F.initcap("role"), F.lit(": "), "text")), "conv_id", "turn", "role", "text"), ["turn", "line"])[1]
    hmm = chat.learn(lines)
    for k, role in enumerate(chat.ROLES):
        for form in range(chat.FORMS):
            best = max((s for s, (_, begins) in enumerate(chat.STATES) if begins), key=lambda s: hmm.emit[s, k * chat.FORMS + form])
            assert chat.STATES[best][0] == role


def test_nulls_empty_texts_repeats_and_empty_tables(spark):
    rows = [(1, 0, "user", None), (1, 1, None, ""), (1, None, "USER", "x"), (None, 0, "robot", "y\r\nz"), (None, 0, "robot", "y\r\nz"), (2, 0, "user", "w " * 100_000)]
    got = chat.transcript_query(frame(spark, rows)).collect()
    assert len(got) == 8 and all(r.role in chat.ROLES and r.n_chars for r in got)
    assert chat.transcript_query(frame(spark, [])).count() == 0
