import math

import numpy as np
import pytest

from civicmesh.operators import map_clusters


def plain(points, deepest, radius=50):
    """Visits points one by one."""
    level = sorted((i, x, y, n) for i, x, y, n in points)
    out = {}
    for zoom in range(deepest, -1, -1):
        r = radius / (512 * 2**zoom)
        done, left = [], list(level)
        while left:
            i, x, y, _ = left[0]
            held = [p for p in left if (p[1] - x) ** 2 + (p[2] - y) ** 2 <= r * r]
            left = [p for p in left if p not in held]
            total = sum(p[3] for p in held)
            done.append((i, sum(p[1] * p[3] for p in held) / total, sum(p[2] * p[3] for p in held) / total, total))
        level = sorted(done)
        out |= {(zoom, i): (n, x, y) for i, x, y, n in level}
    return out


def world(lat, lng):
    s = math.sin(math.radians(lat))
    return lng / 360 + 0.5, 0.5 - 0.25 * math.log((1 + s) / (1 - s)) / math.pi


@pytest.mark.parametrize("seed, spread, deepest", [(1, 0.05, 13), (2, 30.0, 3)])
def test_against_visiting_one_by_one(spark, seed, spread, deepest):
    rng = np.random.default_rng(seed)
    rows = [(int(i), 45 + spread * float(a), -93 + spread * float(b)) for i, (a, b) in zip(rng.permutation(250), rng.normal(size=(250, 2)), strict=True)]
    rows = [(i, max(-80.0, min(80.0, lat)), lng) for i, lat, lng in rows]
    rows += [(900 + k, rows[k][1], rows[k][2]) for k in range(20)]  # places that occur twice
    df = spark.createDataFrame([*rows, (990, None, 1.0), (991, 1.0, None)], "id long, lat double, lng double")
    got = {(r.zoom, r.id): r for r in map_clusters.by_zoom(df, deepest).collect()}
    same = {}
    for i, lat, lng in rows:
        n, least = same.get(world(lat, lng), (0, i))
        same[world(lat, lng)] = (n + 1, min(i, least))
    want = plain([(i, x, y, n) for (x, y), (n, i) in same.items()], deepest)
    assert set(got) == set(want)
    for key, (n, x, y) in want.items():
        assert got[key].n == n
        assert world(got[key].lat, got[key].lng) == pytest.approx((x, y), abs=1e-9)


def test_a_chain_of_circles(spark):
    """Each point lies in its neighbours' circles alone, so what the last one is depends on the first."""
    df = spark.createDataFrame([(i, i * 0.7, 0.5, 1) for i in range(12)], "id long, x double, y double, n long")
    got = {(r.id, r.n) for r in map_clusters.merged(df, 1.0).collect()}
    assert got == {(i, 2) for i in range(0, 12, 2)}


def test_no_points(spark):
    assert map_clusters.by_zoom(spark.createDataFrame([], "id long, lat double, lng double"), 1).count() == 0
