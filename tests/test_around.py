import contextlib
import io
import math

import numpy as np

from civicmesh.operators import around
from civicmesh.vocabulary import EARTH_KM


def km(a, b):
    dlat, dlng = math.radians(b[0] - a[0]), math.radians(b[1] - a[1])
    h = math.sin(dlat / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(dlng / 2) ** 2
    return 2 * EARTH_KM * math.asin(min(1.0, math.sqrt(h)))


def run(spark, centres, points):
    from pyspark.sql import functions as F

    c = spark.createDataFrame(centres, "id long, lat double, lng double, radius double")
    p = spark.createDataFrame(points, "id long, lat double, lng double")
    return around.within(c, p, F.col("radius"))


def test_circles_of_all_sizes_against_every_pair(spark, monkeypatch):
    monkeypatch.setattr(around, "PART", 30)  # crowded cells are split
    rng = np.random.default_rng(5)
    city = [(i, 45 + float(a), -93 + float(b)) for i, (a, b) in enumerate(0.05 * rng.normal(size=(150, 2)))]
    world = [(200 + i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-90, 90, 150), rng.uniform(-180, 180, 150), strict=True))]
    edge = [(400, 0.0, 179.99), (401, 0.0, -179.99), (402, 89.95, 10.0), (403, 89.95, -170.0), (404, -90.0, 0.0), (405, 0.0, 180.0), (406, 0.0, -180.0), (407, 90.0, 0.0)]
    points = [*city, *world, *edge, (500, None, 1.0), (None, 45.0, -93.0)]
    centres = [(i, lat, lng, float(r)) for i, ((_, lat, lng), r) in enumerate(zip([*city[:30], *world[:30], *edge], [*rng.choice([0.0, 0.5, 3, 20, 300], 30), *rng.choice([100, 2000, 9000, 20000], 30), *[5.0] * 4, *[30.0] * 4], strict=True))]
    centres += [(900, 45.0, -93.0, None), (901, None, 1.0, 5.0), (902, 45.0, -93.0, -1.0)]
    got = [(r.centre_id, r.point_id) for r in run(spark, centres, points).collect()]
    want = [(c, i) for c, lat, lng, r in centres if r is not None and lat is not None and r >= 0 for i, y, x in points if y is not None and km((lat, lng), (y, x)) <= r]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_no_nested_loop_and_empty_tables(spark):
    out = io.StringIO()
    df = run(spark, [(1, 45.0, -93.0, 5.0)], [(1, 45.0, -93.0)])
    with contextlib.redirect_stdout(out):
        df.explain()
    assert "NestedLoop" not in out.getvalue() and "Cartesian" not in out.getvalue()
    assert df.count() == 1
    assert run(spark, [], [(1, 45.0, -93.0)]).count() == 0 and run(spark, [(1, 45.0, -93.0, 5.0)], []).count() == 0
