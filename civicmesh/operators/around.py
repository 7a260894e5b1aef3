"""Searches around any number of centres: an equality join on grid cells, then exact distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import written
from ..functions import geo
from ..vocabulary import EARTH_KM

#: Points of a cell from which it is split, and the finest and coarsest grids (cells of 180 / 2 ** level degrees).
PART, FINEST, COARSEST = 50_000, 16, 0


def reach(lat: Column, km: Column) -> tuple[Column, Column]:
    """Degrees of latitude and longitude that a circle covers; at the poles, all longitudes."""
    angle = F.degrees(km / EARTH_KM)
    near_pole = F.abs(lat) + angle >= 89.9
    lng = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.least(angle, F.lit(90.0)))) / F.cos(F.radians(F.least(F.abs(lat), F.lit(89.9)))))))
    return angle, F.when(near_pole, F.lit(180.0)).otherwise(F.least(lng, F.lit(180.0)))


def _row(lat: Column, level: Column) -> Column:
    return F.floor((lat + 90) / (180.0 / F.pow(F.lit(2.0), level))).cast("long")


def _wrapped(column: Column, level: Column) -> Column:
    """Longitudes go round: cells from 180 degrees on are those from -180 on."""
    return F.pmod(column, F.pow(F.lit(2.0), level + 1).cast("long"))


def _column(lng: Column, level: Column) -> Column:
    return F.floor((lng + 180) / (180.0 / F.pow(F.lit(2.0), level))).cast("long")


def within(centres: DataFrame, points: DataFrame, km: Column, centre_id: str = "id", point_id: str = "id", lat: str = "lat", lng: str = "lng") -> DataFrame:
    """centre_id, point_id and km of all points within ``km`` (a column of ``centres``) of each centre.

    A circle is covered by the few cells of a grid about as coarse as itself; points get a cell for each grid in use. Cells
    with very many points are split, and circles that touch them meet each part. Rows without a place take no part, nor do
    circles without a radius; ids that repeat count each."""
    c = centres.select(F.col(centre_id).alias("centre_id"), F.col(lat).alias("c_lat"), F.col(lng).alias("c_lng"), km.cast("double").alias("radius"))
    c = c.dropna(subset=["c_lat", "c_lng", "radius"]).where("radius >= 0")
    dlat, dlng = reach(F.col("c_lat"), F.col("radius"))
    c = c.withColumns({"dlat": dlat * (1 + 1e-9) + 1e-9, "dlng": F.least(dlng * (1 + 1e-9) + 1e-9, F.lit(180.0))})
    level = F.floor(F.log2(180.0 / F.greatest("dlat", "dlng"))).cast("int")
    c = c.withColumn("level", F.greatest(F.least(level, F.lit(FINEST)), F.lit(COARSEST)))
    c = written(c, "centres")
    levels = sorted(r["level"] for r in c.select("level").distinct().collect())  # FINEST + 1 at most
    p = points.select(F.col(point_id).alias("point_id"), F.col(lat).alias("p_lat"), F.col(lng).alias("p_lng")).dropna(subset=["p_lat", "p_lng"])
    p = p.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    p = p.withColumns({"row": _row(F.col("p_lat"), F.col("level")), "column": _wrapped(_column(F.col("p_lng"), F.col("level")), F.col("level"))})
    crowded = p.groupBy("level", "row", "column").count().where(F.col("count") > PART)
    crowded = written(crowded.select("level", "row", "column", F.ceil(F.col("count") / PART).cast("int").alias("parts")), "crowded")
    crowded = F.broadcast(crowded)  # a row for each PART points at most
    key = ["level", "row", "column"]
    one = F.coalesce("parts", F.lit(1))
    p = p.join(crowded, key, "left").withColumn("part", F.pmod(F.xxhash64("point_id", "p_lat", "p_lng"), one).cast("int")).drop("parts")

    rows = F.explode(F.sequence(_row(F.col("c_lat") - F.col("dlat"), F.col("level")), _row(F.col("c_lat") + F.col("dlat"), F.col("level"))))
    across = F.transform(F.sequence(_column(F.col("c_lng") - F.col("dlng"), F.col("level")), _column(F.col("c_lng") + F.col("dlng"), F.col("level"))), lambda x: _wrapped(x, F.col("level")))
    c = c.withColumn("row", rows).withColumn("column", F.explode(F.array_distinct(across)))
    c = c.join(crowded, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), one - 1))).drop("parts")

    away = geo.haversine_km(F.col("c_lat"), F.col("c_lng"), F.col("p_lat"), F.col("p_lng"))
    return c.join(p, [*key, "part"]).withColumn("km", away).where("km <= radius").select("centre_id", "point_id", "km")
