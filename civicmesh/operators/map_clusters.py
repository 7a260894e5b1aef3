"""Clusters of map points by zoom: greedy circles in Web Mercator, each zoom built from the one below it.

Points are visited by id. One that no circle holds yet becomes a centre and takes all later points of its circle that
none has; the cluster has the centre's id, the number of points and their mean place. Clusters of a zoom are the points
of the next one out.

The plane is dealt out in square tiles, each with a margin of its neighbours' points. A task visits its tile's points by id
and settles those whose earlier neighbours are settled and in sight; what hangs on a chain of points from beyond the margin
waits for the next round. So the result does not depend on tiles, and a task holds the places of one tile.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import written

#: Pixels of a circle's radius and of a tile's side, and the deepest zoom that has clusters.
RADIUS, TILE, DEEPEST = 50, 512, 14
POINT = ("id", "x", "y", "n")
#: Side of a tile and width of its margin, in radii, and what stands for an owner that is not known: none yet, or some centre.
SIDE, MARGIN, OPEN, HELD = 32, 4, None, -1


def mercator(lat: Column, lng: Column) -> tuple[Column, Column]:
    """The place on a world from 0 to 1."""
    s = F.sin(F.radians(lat))
    y = 0.5 - 0.25 * F.log((1 + s) / (1 - s)) / math.pi
    return lng / 360.0 + 0.5, F.greatest(F.least(F.coalesce(y, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """lat and lng of a place."""
    return F.degrees(2 * F.atan(F.exp((0.5 - y) * (2 * math.pi))) - math.pi / 2), (x - 0.5) * 360.0


def _visit(radius: float):
    """One task's round: the points of a tile with their owners, as far as they can be known there."""
    side, square = radius / math.sqrt(2) * (1 - 1e-9), radius * radius

    def visit(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py() * SIDE * radius, t.column("j")[0].as_py() * SIDE * radius
        low_x, low_y, width = i - (MARGIN - 1) * radius, j - (MARGIN - 1) * radius, (SIDE + 2 * (MARGIN - 1)) * radius
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("id", "x", "y", "owner")), strict=True))
        cells: dict[tuple[int, int], list] = defaultdict(list)  # of each cell: centres and points that may be some
        owners = {}
        for id, x, y, owner in rows:
            cx, cy = math.floor(x / side), math.floor(y / side)
            if owner is OPEN or owner == HELD:
                near = [p for a in range(cx - 2, cx + 3) for b in range(cy - 2, cy + 3) for p in cells.get((a, b), ()) if (p[1] - x) ** 2 + (p[2] - y) ** 2 <= square]
                sees = 0 <= x - low_x < width and 0 <= y - low_y < width  # its whole circle is in sight
                centre = min((p[0] for p in near if p[3]), default=None)
                maybe = min((p[0] for p in near if not p[3]), default=None)
                if centre is not None:
                    owner = centre if sees and (maybe is None or maybe > centre) else HELD
                elif owner is OPEN and sees and maybe is None:
                    owner = id
            owners[id] = owner
            if owner is OPEN or owner == id:
                cells[cx, cy].append((id, x, y, owner == id))
        mine = t.filter(t.column("own"))
        return mine.select(list(POINT)).append_column("owner", pa.array([owners[k] for k in mine.column("id").to_pylist()], pa.int64()))

    return visit


def merged(points: DataFrame, radius: float) -> DataFrame:
    """Clusters (id, x, y, n) of ``points`` (the same; ids are not negative and differ)."""
    size = SIDE * radius
    schema = "id long, x double, y double, n long, owner long"
    rows = points.select(F.col("id").cast("long"), "x", "y", F.col("n").cast("long"), F.lit(OPEN).cast("long").alias("owner"))
    reach = lambda v: F.sequence(F.floor((F.col(v) - MARGIN * radius) / size), F.floor((F.col(v) + MARGIN * radius) / size))
    while True:
        tiled = rows.withColumn("i", F.explode(reach("x"))).withColumn("j", F.explode(reach("y")))
        own = (F.col("i") == F.floor(F.col("x") / size)) & (F.col("j") == F.floor(F.col("y") / size))
        rows = written(tiled.withColumn("own", own).groupBy("i", "j").applyInArrow(_visit(radius), schema), "circles")
        if rows.where(F.col("owner").isNull() | (F.col("owner") == HELD)).isEmpty():
            break
    mean = lambda v: (F.sum(F.col(v) * F.col("n")) / F.sum("n")).alias(v)
    return rows.groupBy(F.col("owner").alias("id")).agg(mean("x"), mean("y"), F.sum("n").alias("n")).select(*POINT)


def by_zoom(rows: DataFrame, deepest: int = DEEPEST, radius: int = RADIUS, id: str = "id", lat: str = "lat", lng: str = "lng") -> DataFrame:
    """zoom, id, lat, lng and n of the clusters of each zoom from ``deepest`` to 0; a point alone is a cluster of one.

    Rows without a place or id take no part; ids are not negative. Rows at one place are one point of the first one's id and with their number, which
    the visiting order allows: whatever circle holds one of them holds all."""
    x, y = mercator(F.col(lat), F.col(lng))
    placed = rows.where(F.col(lat).isNotNull() & F.col(lng).isNotNull() & F.col(id).isNotNull())
    points = placed.select(F.col(id).alias("id"), x.alias("x"), y.alias("y")).groupBy("x", "y").agg(F.min("id").alias("id"), F.count("*").alias("n")).select(*POINT)
    out = None
    for zoom in range(deepest, -1, -1):
        points = written(merged(points, radius / (TILE * 2**zoom)), "clusters")
        at, beside = degrees(F.col("x"), F.col("y"))
        level = points.select(F.lit(zoom).alias("zoom"), "id", at.alias("lat"), beside.alias("lng"), "n")
        out = level if out is None else out.unionByName(level)
    return out
