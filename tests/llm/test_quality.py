import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from civicmesh.llm import quality

SF = "/root/testdata/sf0.01"


def texts(n=400, seed=0):
    """Label 1: prose; label 0: symbols, repeats and shouting."""
    rng = np.random.default_rng(seed)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        good = bool(rng.integers(2))
        n_words = int(rng.integers(20, 200))
        text = " ".join(rng.choice(words, n_words)) + "." if good else "\n".join(["BUY NOW!!! $$$ ###"] * int(rng.integers(2, 30)))
        rows.append((i, text))
        labels.append((i, int(good)))
    return rows, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def scored(spark, rows, labels):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("clash"), "label": F.lit(1), "statistics": F.lit(0)}).repartition(3)
    return quality.quality_scores(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()


def test_held_out_documents_are_judged_right(spark):
    rows, labels = texts()
    got = {r.doc_id: r for r in scored(spark, rows, labels)}
    truth = dict(labels)
    assert len(got) == len(rows)
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    assert np.mean([r.predicted == truth[i] for i, r in got.items() if r.held_out]) > 0.95


def test_labels_of_held_out_rows_change_nothing(spark):
    rows, labels = texts(200, 1)
    flipped = [(i, 1 - q if held(i) else q) for i, q in labels]
    assert {(r.doc_id, r.score) for r in scored(spark, rows, labels)} == {(r.doc_id, r.score) for r in scored(spark, rows, flipped)}


def test_nulls_empty_texts_repeats_and_no_labels(spark):
    rows, labels = texts(60, 2)
    odd = [(100, None), (101, ""), (102, " \n\t"), (None, "some words"), (3, rows[3][1]), (103, "x" * 200_000), (104, "a\x00b é 漢")]
    got = scored(spark, rows + odd, labels + [(100, None), (None, 1), (3, 0)])
    assert len(got) == 67 and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.score)
    assert by[100] == by[101] == by[102] and by[3][0] == by[3][1]
    assert {r.score for r in scored(spark, rows, [])} == {0.5}
    assert scored(spark, [], labels) == []


def test_keep_good_keeps_what_is_not_rejected(spark):
    rows, labels = texts(200, 3)
    df = spark.createDataFrame(rows + [(None, "words here")], "doc_id long, text string")
    named = spark.createDataFrame(labels, "doc_id long, quality int")
    kept = {r.doc_id for r in quality.keep_good(df, named).collect()}
    assert kept == {r.doc_id for r in quality.quality_scores(df, named).collect() if r.predicted or r.doc_id is None}


def test_ridge_equals_the_plain_solution(spark):
    rows, labels = texts(150, 4)
    x = np.array([quality.statistics(t.encode()) for _, t in rows])
    y = np.array([q for _, q in labels], float)
    df = spark.createDataFrame([(v.tolist(), float(q)) for v, q in zip(x, y, strict=True)], "statistics array<double>, label double").repartition(4)
    model = quality.fit(df)
    z = model.features(x)
    assert np.allclose(model.mean, x.mean(0)) and z.shape == (150, quality.FEATURES + 1)
    penalty = quality.RIDGE * 150 * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-9 * 150
    want = z @ np.linalg.solve(z.T @ z + penalty, z.T @ y)
    assert np.allclose(model.raw(x), want, atol=1e-6)


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(0)
    d = len(quality.STATISTICS)
    model = quality.Model(np.zeros(d), np.ones(d), features=20_000)
    x = rng.normal(size=(30, d))
    z = model.features(x)[:, :-1]
    variance = 1 / (2 * d / 4)
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) * variance / 2)
    assert np.abs(z @ z.T - want).max() < 0.05


@pytest.mark.parametrize("seed", range(5))
def test_isotonic_equals_the_min_max_formula(seed):
    rng = np.random.default_rng(seed)
    n = rng.integers(1, 9, 25).astype(float)
    y = np.floor(rng.uniform(size=25) * (n + 1))
    x = np.arange(25.0)
    grid, value = quality.isotonic(x, y, n)
    mean = lambda a, b: y[a : b + 1].sum() / n[a : b + 1].sum()
    want = [max(min(mean(a, b) for b in range(i, 25)) for a in range(i + 1)) for i in range(25)]
    assert sorted({*np.round(value, 9)}) == sorted({*np.round(want, 9)}) and (np.diff(grid) > 0).all()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_accuracy_on_the_test_tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_scores(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", "quality", "score").toPandas()
    good, bad = rows[rows["quality"] == 1], rows[rows["quality"] == 0]
    assert (good["predicted"] == 1).mean() >= 0.9
    wins = (good["score"].to_numpy()[:, None] > bad["score"].to_numpy()).mean() + 0.5 * (good["score"].to_numpy()[:, None] == bad["score"].to_numpy()).mean()
    assert wins >= 0.75
