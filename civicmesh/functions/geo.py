"""Places on the sphere."""

from __future__ import annotations

from math import cos, radians

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocabulary import EARTH_KM, SENSITIVITY_STEPS

GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def box(lat: float, lng: float, radius_km: float) -> tuple[float, float, float, float]:
    """min_lat, max_lat, min_lng, max_lng around a point."""
    dlat, dlng = radius_km / 111.0, radius_km / (111.0 * cos(radians(lat)))
    return lat - dlat, lat + dlat, lng - dlng, lng + dlng


def in_box(lat: Column, lng: Column, bounds: tuple[float, float, float, float]) -> Column:
    return lat.between(bounds[0], bounds[1]) & lng.between(bounds[2], bounds[3])


def snapped(value: Column, sensitivity: Column) -> Column:
    """A coordinate on the grid that its sensitivity asks for; general ones as they are."""
    out = value
    for name, step in SENSITIVITY_STEPS.items():
        out = F.when(sensitivity == name, F.round(value / step) * step).otherwise(out)
    return out


def precision(sensitivity: Column) -> Column:
    return F.when(sensitivity == "sensitive", "approximate").when(sensitivity == "elevated", "neighborhood").otherwise("exact")


def cell(value: Column, size: float = 0.05) -> Column:
    return F.round(value / size).cast("long")


def geohash(lat: Column, lng: Column, length: int = 5) -> Column:
    """Base-32 geohash: longitude and latitude bits in turn, longitude first."""
    bits = 5 * length
    x_bits, y_bits = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((lng + 180) / 360 * (1 << x_bits)), F.lit((1 << x_bits) - 1)).cast("long")
    y = F.least(F.floor((lat + 90) / 180 * (1 << y_bits)), F.lit((1 << y_bits) - 1)).cast("long")
    out = []
    for c in range(length):
        digit = F.lit(0).cast("long")
        for b in range(5 * c, 5 * c + 5):
            of, n, i = (x, x_bits, b // 2) if b % 2 == 0 else (y, y_bits, b // 2)
            digit = digit * 2 + F.shiftright(of, n - 1 - i).bitwiseAND(F.lit(1).cast("long"))
        out.append(F.substring(F.lit(GEOHASH), (digit + 1).cast("int"), F.lit(1)))
    return F.concat(*out)


def off_centre(lat: Column, lng: Column, centre: tuple[float, float], within: float = 0.02) -> Column:
    """Whether coordinates are not just a region's centre put in for want of better."""
    return ~((F.abs(lat - centre[0]) < within) & (F.abs(lng - centre[1]) < within))


def label(lat: Column, lng: Column) -> Column:
    return F.when(lat.isNull() | lng.isNull(), "unknown").otherwise(F.format_string("%.4f, %.4f", lat, lng))
