import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from civicmesh.llm import mixing, queries

LIBRARY = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER_WORD))


def corpus(seed=0):
    """Prose and junk, near and exact copies, labels on most rows, and odd rows."""
    rng = np.random.default_rng(seed)
    words = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(240):
        if i % 4 == 3:
            text, good = "\n".join(["WIN $$$ !!! ###"] * int(rng.integers(3, 40))), 0
        else:
            text, good = " ".join(rng.choice(words, int(rng.integers(150, 400)))) + ".", 1
        rows.append((i, text))
        if i % 5:
            labels.append((i, good, 0))
    rows += [(1000 + i, rows[i][1]) for i in range(0, 60, 4)]  # exact copies
    rows += [(2000 + i, rows[i][1].replace(".", " more.")) for i in range(1, 60, 4)]  # near copies
    return rows + [(3000, None), (3001, ""), (3002, "é漢 " * 5000)], labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows, labels = corpus()
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def by_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        yield name, before, docs


def test_stages_do_what_their_operators_say(spark, tables):
    stages = {name: (before, after) for name, before, after in by_stage(spark, tables)}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "mixing", "encoding"]
    for name, (before, after) in stages.items():
        if name != "encoding":
            assert after.schema == before.schema

    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    _, good = stages["quality"]
    kept = ids(good)
    wanted = {r.doc_id for r in queries.op5_quality(spark, tables).where("predicted = 1").collect()}
    assert set(kept) == wanted
    prose = {i for i, t in corpus()[0] if t and t.startswith("word")}
    assert prose <= set(kept) and not any(i in kept for i in range(3, 240, 4))

    from test_simhash import plain_components

    rows = [(r.doc_id, r.text) for r in good.collect()]
    classes = plain_components(rows)
    unique = ids(stages["near_duplicates"][1])
    assert set(unique) == {c for _, c in classes.values()} and max(unique.values()) == 1
    assert not any(1000 + i in unique for i in range(0, 60, 4) if i % 4 != 3)

    before, mixed = stages["mixing"]
    rates = mixing.mix_rates(before, queries.label_domains(spark.read.parquet(f"{tables}/labels.parquet")), corpus_pipeline.TARGETS, epochs=corpus_pipeline.EPOCHS).collect()
    assert ids(mixed) == Counter({r.doc_id: r.copies for r in rates if r.copies})
    assert all(r.copies >= 1 for r in rates if r.doc_id in prose)

    text = {r.doc_id: r.text for r in mixed.collect()}
    encoded = stages["encoding"][1].collect()
    assert Counter(r.doc_id for r in encoded) == ids(mixed)
    for r in encoded:
        e = LIBRARY.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(e), sha(" ".join(map(str, e))), sha(LIBRARY.decode(e, skip_special_tokens=False)))


def test_run_gives_the_last_stage(spark, tables):
    *_, (_, _, last) = by_stage(spark, tables)
    assert sorted(map(tuple, corpus_pipeline.run(spark, tables).collect())) == sorted(map(tuple, last.collect()))


def test_empty_table(spark, tables, tmp_path):
    spark.read.parquet(f"{tables}/documents.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    """Null and repeated doc_ids, null texts, more columns than the contract's: each row is judged by its own text."""
    rows, labels = corpus()
    prose = dict(rows)[0]
    extra = [(None, "one more " + prose), (None, "\n".join(["WIN $$$ !!! ###"] * 30)), (4, dict(rows)[4]), (9000, "lone " * 200 + prose), (9000, "\n".join(["WIN $$$ !!! ###"] * 20))]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t or ""), "clash", 7) for i, t in rows + extra], "doc_id long, text string, lang string, source string, n_chars long, posterior string, __row long")
    docs = docs.withColumnRenamed("__row", "rate")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = {name: (before, after) for name, before, after in by_stage(spark, str(tmp_path))}
    texts = [(r.doc_id, r.text) for r in stages["quality"][1].collect()]
    assert (None, "one more " + prose) in texts and not any(t and t.startswith("WIN") for _, t in texts)
    assert (9000, "lone " * 200 + prose) in texts and texts.count((4, dict(rows)[4])) == 2
    assert [r.doc_id for r in stages["near_duplicates"][1].collect()].count(4) == 1
    assert all(after.columns == before.columns for name, (before, after) in stages.items() if name != "encoding")
    assert stages["encoding"][1].count() == stages["mixing"][1].count()
