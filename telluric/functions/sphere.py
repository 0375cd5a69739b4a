"""Spherical geometry as Column functions. Angles in radians unless a name says degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS = 6371e3


def with_trig(points: DataFrame, prefix: str) -> DataFrame:
    """points (lat, lon in degrees) with {prefix}_sin, _cos of the latitude and {prefix}_lon in radians.

    To be applied to each side below a join, so that no pair computes them anew.
    """
    lat = F.radians("lat")
    return points.withColumns({f"{prefix}_sin": F.sin(lat), f"{prefix}_cos": F.cos(lat), f"{prefix}_lon": F.radians("lon")})


def angle(a: str, b: str, clamp: bool = False) -> Column:
    """Central angle between the points that with_trig has prepared under prefixes a and b.

    The cosine may come out above 1 for coincident points, which gives NaN; clamp=True cuts it to [-1, 1].
    """
    z = F.col(f"{a}_sin") * F.col(f"{b}_sin") + F.col(f"{a}_cos") * F.col(f"{b}_cos") * F.cos(F.col(f"{b}_lon") - F.col(f"{a}_lon"))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z)) if clamp else z)


def bearing(a: str, b: str) -> Column:
    """Direction from a to b, counted from East to North: pi/2 less the azimuth, in [-pi/2, 3 pi/2)."""
    d = F.col(f"{b}_lon") - F.col(f"{a}_lon")
    east = F.col(f"{b}_cos") * F.sin(d)
    north = F.col(f"{a}_cos") * F.col(f"{b}_sin") - F.col(f"{a}_sin") * F.col(f"{b}_cos") * F.cos(d)
    return F.pi() / 2 - F.atan2(east, north)


def flat_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance in metres between points in degrees; a difference across 180° East is not wrapped."""
    x = (F.radians(lon2) - F.radians(lon1)) * F.cos((F.radians(lat1) + F.radians(lat2)) / 2)
    y = F.radians(lat1) - F.radians(lat2)
    return F.sqrt(x * x + y * y) * EARTH_RADIUS
