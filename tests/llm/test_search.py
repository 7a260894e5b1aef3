import numpy as np
import pytest
from pyspark.sql import functions as F

from civicmesh.llm import neighbours, top_k
from civicmesh.llm.hilbert import hilbert_bytes, hilbert_keys

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", -1) for i, v in rows], SCHEMA)


def vectors(n=400, d=8, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(size=d).round(2).astype(np.float32).tolist()) for i in range(n)]


def odd_rows():
    """Ties, copies (more than k of them), repeated rows, nulls, empty, non-finite, zero and shorter vectors."""
    x = vectors()
    copies = [(1000 + i, x[50][1]) for i in range(30)]
    more = [(2000, None), (2001, [1.0] * 7 + [None]), (2050, [1.0] * 7 + [float("nan")]), (2002, [1.0] * 7 + [float("inf")]), (2003, [0.0] * 8), (2004, []), (2100, [1.0, 2.0]), (2101, [2.0, 1.0]), (None, [1.0] * 8)]
    return x + copies + [x[3], x[100]] + more


def plain_top(rows, k=5, every=50):
    ok = [(i, np.floor(np.array(v, np.float32).astype(float) * 256)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = set()
    for q, a in ok:
        if q % every == 0:
            s = sorted((-int(a @ b), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out |= {(q, r + 1, i, -x) for r, (x, i) in enumerate(s)}
    return out


@pytest.mark.parametrize("block, batch", [(4096, 1024), (64, 3)])
def test_top_k_is_exact(spark, block, batch):
    rows = [r for r in odd_rows() if r[0] not in (3, 100)]  # repeated ids: next test
    got = top_k.top_k(frame(spark, rows).repartition(3), block=block, batch=batch).collect()
    assert {tuple(r) for r in got} == plain_top(rows)


def test_top_k_repeated_ids_empty_table_and_few_rows(spark):
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0])]
    got = {tuple(r) for r in top_k.top_k(frame(spark, rows)).collect()}
    assert {(r[0], r[2], r[3]) for r in got} == {(50, 3, 65536)}
    ranks = sorted((r[0], r[1], r[2]) for r in top_k.top_k(frame(spark, rows)).collect())
    assert ranks == [(50, 1, 3), (50, 1, 3), (50, 2, 3), (50, 2, 3)]  # a list for each of the two rows
    two = [(50, [1.0, 0.0]), (50, [-1.0, 0.0]), *((i, [float(i), 0.0]) for i in range(1, 9))]
    for block in (3, 1000):
        got = sorted((r[1], r[2]) for r in top_k.top_k(frame(spark, two), block=block).collect())
        assert got == sorted([*zip(range(1, 6), (8, 7, 6, 5, 4), strict=True), *zip(range(1, 6), (1, 2, 3, 4, 5), strict=True)])
    assert top_k.top_k(frame(spark, [])).count() == 0
    assert top_k.top_k(frame(spark, [(50, [1.0])])).count() == 0


def test_wide_vectors_come_in_smaller_blocks(spark, monkeypatch):
    monkeypatch.setattr(top_k, "BLOCK_BYTES", 8 * 1024 * 40)  # forty rows of 1,024 dimensions
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(120, 1024)))]
    x = np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
    got = {(r[0], r[1]): (r[2], r[3]) for r in top_k.top_k(frame(spark, rows)).collect()}
    for q in (0, 50, 100):
        want = sorted((-int(x[q] @ x[c]), c) for c in range(120) if c != q)[:5]
        assert [got[q, r + 1] for r in range(5)] == [(c, -s) for s, c in want]


def want_top(rows, q, k=5):
    scores = [sum(int(a) * int(b) for a, b in zip(x, q, strict=True)) for x in rows]
    return sorted((-s, i) for i, s in enumerate(scores))[:k]


def found_top(found, j):
    q, c, s, _ = found
    return [(-int(x), int(i)) for x, i in zip(s[q == j], c[q == j], strict=True)]


def test_threshold_stops_before_all_rows_are_seen_and_is_exact():
    rng = np.random.default_rng(2)
    rows = np.floor(rng.exponential(size=(3000, 3)) ** 3 * 256).astype(np.int64)
    q = np.floor(rng.exponential(size=(20, 3)) * 256).astype(np.int64)
    found = top_k.threshold_search(np.arange(3000), rows, -np.ones(20, int), q, 5)
    assert all(found_top(found, j) == want_top(rows, q[j]) for j in range(20))
    assert found[3] < 1500


def test_lists_in_principal_directions_stop_early_where_few_directions_matter():
    rng = np.random.default_rng(3)
    rows = np.floor(256 * (rng.normal(size=(4000, 3)) @ rng.normal(size=(3, 64)) + 0.001 * rng.normal(size=(4000, 64)))).astype(np.int64)
    found = top_k.threshold_search(np.arange(4000), rows, np.arange(0, 10), rows[:10], 5)
    for j in range(10):
        others = np.delete(rows, j, 0)
        assert [(x, i - (i > j)) for x, i in found_top(found, j)] == want_top(others, rows[j])
    assert found[3] < 3000


def test_a_score_from_elsewhere_stops_a_block_of_low_rows_at_once():
    rng = np.random.default_rng(4)
    low, q = rng.integers(0, 10, (2000, 8)), rng.integers(50, 100, (5, 8))
    assert top_k.threshold_search(np.arange(2000), low, -np.ones(5, int), q, 5, np.full(5, 1e6))[3] == 0
    floors = np.array([-want_top(low, x)[4][0] for x in q], float)  # equal scores may still enter by smaller ids
    found = top_k.threshold_search(np.arange(2000), low, -np.ones(5, int), q, 5, floors)
    assert all(found_top(found, j) == want_top(low, q[j]) for j in range(5))


@pytest.mark.parametrize("size", [1 << 20, 1 << 27, 1 << 33])
def test_large_components_are_summed_exactly(size):
    rng = np.random.default_rng(5)
    rows, q = rng.integers(size - 50, size, (200, 16)), rng.integers(size - 50, size, (4, 16))
    found = top_k.threshold_search(np.arange(200), rows, -np.ones(4, int), q, 5)
    assert all(found_top(found, j) == want_top(rows, q[j]) for j in range(4))


def test_large_components_end_to_end(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (1e6 + rng.integers(0, 3, 4)).astype(float).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {(r.query_id, r["rank"]): (-r.score, r.vec_id) for r in top_k.top_k(df, block=50, batch=2).collect()}
    for q in (0, 50, 100):
        scores = sorted((-sum(int(256 * a) * int(256 * b) for a, b in zip(v, rows[q][1], strict=True)), i) for i, v in rows if i != q)
        assert [got[q, r] for r in range(1, 6)] == scores[:5]


def plain_nearest(rows, k=5, every=50):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q, a in ok.items():
        if q % every == 0:
            out[q] = sorted((-round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 12), i) for i, b in ok.items() if i != q)[:k]
    return out


def test_nearest_over_small_tables_is_exact(spark):
    rows = [(i, None if v is None else [None if y is None else float(np.float32(y)) for y in v]) for i, v in odd_rows()]
    got = {}
    for r in neighbours.nearest(frame(spark, rows).repartition(3)).collect():
        got.setdefault(r.query_id, []).append((r.rank, -round(r.score, 12), r.vec_id))
    want = plain_nearest(rows)
    assert {q: [x[1:] for x in sorted(v)] for q, v in got.items()} == {q: v for q, v in want.items()}


def recall(spark, x, every=50, plan=None):
    """The share of the five best cosines that ``nearest`` finds, by brute force; ties count."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in neighbours.nearest(df, every=every, plan=plan).collect():
        got.setdefault(r.query_id, []).append(r.score)
    u = neighbours._directions(x)
    queries = range(0, len(x), every)
    hit = 0
    for q in queries:
        s = u @ u[q]
        s[q] = -9
        hit += sum(y >= np.sort(s)[-5] - 1e-15 for y in got.get(q, []))
    return hit / (5 * len(queries))


def used(monkeypatch):
    """The plans that ``nearest`` fits."""
    plans, fit = [], neighbours.fitted
    monkeypatch.setattr(neighbours, "fitted", lambda *a: plans.append(fit(*a)) or plans[-1])
    return plans


def share(plan, n):
    """Rows that a query is compared with at most, as a share of the table."""
    return plan.curves * (2 * plan.reach + 1) * plan.block / n


def test_clustered_vectors_need_a_small_part_of_the_table(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(500, 24)), 40, axis=0) + 0.3 * rng.normal(size=(20_000, 24))
    plans = used(monkeypatch)
    assert recall(spark, rng.permutation(x), every=100) >= 0.9
    assert share(plans[0], 20_000) < 0.25


def test_recall_does_not_depend_on_norms(spark):
    rng = np.random.default_rng(6)
    assert recall(spark, rng.normal(size=(6000, 8)) * 10.0 ** rng.uniform(-5, 5, (6000, 1))) >= 0.9


@pytest.mark.parametrize("part, width", [(3, 1e-6), (10, 1e-4)])
def test_recall_inside_a_tight_cluster(spark, part, width):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 8))
    x[::part] = x[0] + width * rng.normal(size=x[::part].shape)
    assert recall(spark, x, every=50 * part) >= 0.9


def test_collinear_vectors_tie_by_id(spark):
    rng = np.random.default_rng(10)
    base = rng.integers(1, 50, (40, 6))
    x = [(i, (base[i % 40] * (1 + i // 40)).astype(float).tolist()) for i in range(400)]  # ten multiples of each
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(x, "vec_id long, embedding array<double>").repartition(3)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q in range(0, 400, 50):
        assert [i for _, i in sorted(got[q])] == [i for i in range(q % 40, 400, 40) if i != q][:5]


def test_blocks_around_a_query_reach_over_borders(spark):
    x = np.stack([np.cos(t := np.linspace(0, 3, 3000)), np.sin(t)], 1)
    assert recall(spark, x, plan=neighbours.Plan(3, 40, 1)) == 1.0


@pytest.mark.parametrize("block, n", [(8192, 1), (3, 40)])
def test_places_are_counts_of_borders(block, n):
    rng = np.random.default_rng(11)
    raw = rng.integers(0, 4, (200, 11)).astype(np.uint8)
    keys = np.ascontiguousarray(raw).view("V11").ravel()
    marks = neighbours._sorted(keys[:n])
    assert neighbours._places(marks, keys).tolist() == [sum(m.tobytes() <= k.tobytes() for m in marks) for k in keys]


def test_hilbert_bytes_are_ordered_like_keys():
    cells = np.random.default_rng(8).integers(0, 1 << 7, (500, 8))
    assert np.argsort(hilbert_keys(cells, 7), kind="stable").tolist() == np.lexsort(hilbert_bytes(cells, 7).T[::-1]).tolist()


def test_nearest_of_nothing(spark):
    assert neighbours.nearest(frame(spark, [])).count() == 0
    assert neighbours.nearest(frame(spark, [(50, [1.0, 0.0])])).count() == 0
    assert [tuple(r) for r in neighbours.nearest(frame(spark, [(50, [1.0, 0.0]), (1, [0.0, 2.0])])).collect()] == [(50, 1, 1, 0.0)]


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (5, 2), (1, 5)])
def test_hilbert_neighbours_are_adjacent(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_integers_floor(spark):
    row = spark.createDataFrame([([0.1, -0.1, 0.0, 1.0],)], "v array<float>").select(top_k.integers("v").alias("x")).first()
    assert row.x == [int(np.floor(float(np.float32(y)) * 256)) for y in (0.1, -0.1, 0.0, 1.0)]
    assert F is not None
