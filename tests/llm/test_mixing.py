import numpy as np
import pytest
from pyspark.sql import functions as F

from civicmesh.llm import mixing

TARGETS = {"good": 0.7, "bad": 0.3}
SCHEMA = "doc_id long, text string"


def corpus():
    """Two kinds of documents with words of their own and some shared ones, of very different sizes."""
    rng = np.random.default_rng(4)
    own = {"good": [f"g{i}" for i in range(30)], "bad": [f"b{i}" for i in range(30)]}
    rows, labels = [], []
    for i in range(300):
        kind = "good" if i % 3 == 0 else "bad"
        rows.append((i, " ".join(rng.choice(own[kind] + ["shared", "words"], int(rng.integers(1, 80))))))
        if i % 2 == 0:
            labels.append((i, kind))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, domain string")


def plain_loss(tokens, posterior, rate, targets):
    return (((tokens * rate) @ posterior / tokens.sum() - targets) ** 2 / targets).sum()


def plain_rates(tokens, posterior, targets):
    """Projected gradients over every document's own rate, step by step, without inertia."""
    r, t = np.ones(len(tokens)), tokens / tokens.sum()
    step = 1 / np.linalg.eigvalsh((t[:, None] * posterior).T @ posterior / np.sqrt(np.outer(targets, targets))).max()
    for _ in range(20_000):
        r = np.maximum(0, r - step * posterior @ (((t * r) @ posterior - targets) / targets))
    return r


def test_totals_meet_the_targets_and_rates_equal_plain_gradients(spark):
    df, labels = frames(spark, *corpus())
    rows = mixing.mix_rates(df, labels, TARGETS).toPandas().sort_values("doc_id")
    tokens, p = rows["tokens"].to_numpy(float), rows[["p_bad", "p_good"]].to_numpy(float)
    rate = rows["rate"].to_numpy(float)
    assert (rate >= 0).all() and np.allclose(p.sum(1), 1, atol=1e-5)
    got = (tokens * rate) @ p / tokens.sum()
    assert np.allclose(got, [0.3, 0.7], atol=1e-3)
    want = plain_rates(tokens, p, np.array([0.3, 0.7]))
    assert np.allclose(rate, want, atol=0.02)
    named = {i: d for i, d in corpus()[1]}
    assert np.mean([named[i] == d for i, d in zip(rows["doc_id"], rows["domain"], strict=True) if i in named]) > 0.95


def test_targets_out_of_reach_are_met_as_nearly_as_plain_gradients_do(spark):
    rng = np.random.default_rng(3)
    tokens, p = rng.integers(1, 500, 400), rng.dirichlet([4, 2, 1], 400)
    p = 0.8 * p + 0.2 * np.array([0.5, 0.3, 0.2])  # no document has less than a tenth of the first domain
    rows = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p, strict=True)], "tokens long, posterior array<double>")
    targets = np.array([0.02, 0.08, 0.9])
    rates, shares = mixing.fit_rates(rows, targets.tolist())
    of = {tuple(r.posterior): r.rate for r in rates.collect()}
    rate = np.array([of[tuple(x)] for x in p.tolist()])
    assert (rate >= 0).all() and (rate == 0).any()
    assert np.allclose((tokens * rate) @ p / tokens.sum(), shares, atol=1e-9)
    plain = plain_loss(tokens, p, plain_rates(tokens, p, targets), targets)  # slow here: its loss still falls after all its rounds
    assert plain_loss(tokens, p, rate, targets) <= plain
    # the conditions of the least loss: no row's rate can gain by rising, none above zero by falling
    t = tokens * rate / tokens.sum()
    slope = p @ ((t @ p - targets) / targets)
    assert slope.min() > -1e-3 and abs(t @ slope) < 1e-3


def test_stored_cells_give_the_same_rates(spark, monkeypatch):
    rows = spark.createDataFrame([(90, [0.9, 0.1]), (30, [0.2, 0.8]), (40, [0.2, 0.8]), (10, [0.5, 0.5])], "tokens long, posterior array<double>")
    held, shares = mixing.fit_rates(rows, [0.4, 0.6])
    monkeypatch.setattr(mixing, "NUMBERS", 0)
    stored, again = mixing.fit_rates(rows, [0.4, 0.6])
    assert again == pytest.approx(shares) and shares == pytest.approx([0.4, 0.6], abs=1e-5)
    of = lambda df: {tuple(r.posterior): round(r.rate, 9) for r in df.collect()}
    assert of(held) == of(stored) and len(of(held)) == 3


def test_a_fit_that_does_not_end_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing._Held, "rounds", 2)
    rows = spark.createDataFrame([(9, [0.9, 0.1]), (3, [0.2, 0.8])], "tokens long, posterior array<double>")
    with pytest.raises(RuntimeError, match="converge"):
        mixing.fit_rates(rows, [0.6, 0.4])


def test_registered_targets_are_met(spark):
    from civicmesh.llm import queries

    rows = queries.op1_mixing(spark, "/root/testdata/sf0.1")
    names = sorted(queries.TARGETS)
    w = F.col("tokens") * F.col("rate")
    got = rows.agg(F.sum("tokens").alias("t"), *(F.sum(w * F.col(f"p_{d}")).alias(d) for d in names)).first()
    assert {d: got[d] / got["t"] for d in names} == pytest.approx(queries.TARGETS, abs=5e-4)


def test_long_and_missing_texts(spark):
    rows, labels = corpus()
    df, known = frames(spark, [*rows, (900, "g1 b2 " * 300_000), (901, None), (902, " "), (5, rows[5][1])], labels)
    got = {(r.doc_id, r.tokens) for r in mixing.mix_rates(df, known, TARGETS).collect()}
    assert {(900, 600_000), (901, 0), (902, 0)} <= got and len(got) == 303


def test_true_shares_of_rows_that_taught_nothing_are_near_the_targets(spark):
    """A rare domain shows in few words of long texts; labels of a third of the rows are only looked at in the end."""
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(3000):
        kind = rng.choice(["plain", "rare"], p=[0.85, 0.15])
        text = rng.choice([f"w{j}" for j in range(2000)], int(rng.integers(20, 300))).tolist()
        if kind == "rare":
            for at in rng.integers(0, len(text), rng.integers(1, 6)):
                text[at] = f"r{rng.integers(10)}"
        rows.append((i, " ".join(text)))
        labels.append((i, kind))
    df, known = frames(spark, rows, [x for x in labels if x[0] % 3])
    got = mixing.mix_rates(df, known, {"plain": 0.95, "rare": 0.05}).toPandas()
    truth, tokens = dict(labels), (got["tokens"] * got["rate"]).to_numpy()
    unseen = got["doc_id"].to_numpy() % 3 == 0
    rare = np.array([truth[i] == "rare" for i in got["doc_id"]])
    assert tokens[unseen & rare].sum() / tokens[unseen].sum() == pytest.approx(0.05, rel=0.35)


def test_too_many_domains_are_an_error(spark):
    df, labels = frames(spark, corpus()[0], [(i, f"d{i}") for i in range(100)])
    with pytest.raises(ValueError, match="domains"):
        mixing.learn(df, labels)


def test_epochs_scale_the_mixture(spark):
    df, labels = frames(spark, *corpus())
    rows = mixing.mix_rates(df, labels, {"good": 0.4, "bad": 0.6}, epochs=1.5).toPandas()
    got = (rows["tokens"] * rows["rate"]).to_numpy() @ rows[["p_bad", "p_good"]].to_numpy() / rows["tokens"].sum()
    assert np.allclose(got, [0.9, 0.6], atol=1e-3)


def test_a_domain_that_is_to_go_gets_no_copies(spark):
    df, labels = frames(spark, *corpus())
    rows = mixing.mix_rates(df, labels, {"good": 1.0}).toPandas()
    sure = rows[rows["p_bad"] > 0.99]
    assert len(sure) and (sure["rate"] < 0.05).all()
    assert (rows[rows["p_good"] > 0.99]["rate"] > 1).all()


def test_mix_repeats_each_row_by_its_rate_and_keeps_the_columns(spark):
    rows, labels = corpus()
    df, labels = frames(spark, rows + [(900, None), (901, ""), (None, "g1 g2"), (5, dict(rows)[5])], labels)
    df = df.withColumns({"rate": F.lit("clash"), "copies": F.lit(7), "posterior": F.lit(1), "tokens": F.lit("x"), "__n": F.lit(3)})
    got = mixing.mix(df, labels, TARGETS)
    assert got.dtypes == df.dtypes
    rates = mixing.mix_rates(df, labels, TARGETS).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()
    counts = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert counts == {r["doc_id"]: r["n"] for r in rates if r["n"]}
    assert {r["rate"] for r in got.select("rate").distinct().collect()} == {"clash"}


@pytest.mark.parametrize("labelled", [[], [(None, "good"), (3, None)]])
def test_without_labels_all_is_one_domain(spark, labelled):
    df, labels = frames(spark, corpus()[0], labelled)
    assert {(r.domain, r.copies) for r in mixing.mix_rates(df, labels, TARGETS).collect()} == {("none", 1)}


def test_empty_tables(spark):
    df, labels = frames(spark, [], corpus()[1])
    assert mixing.mix_rates(df, labels, TARGETS).count() == 0
    assert mixing.mix(df, labels, TARGETS).count() == 0


def test_no_python_on_the_executors(spark):
    df, labels = frames(spark, *corpus())
    plan = mixing.mix(df, labels, TARGETS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
