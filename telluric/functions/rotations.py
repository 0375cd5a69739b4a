"""Rotations of the contour map as Column functions; all in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Geomagnetic poles that contours use, (longitude, latitude).
NORTH, SOUTH = (-72.8, 80.8), (107.2, -80.8)
SHIFT = 20.0


def _cartesian(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lon), F.radians(lat)
    return F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)


def _degrees(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    return F.degrees(F.atan2(y, x)), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z))))


def _wrapped(lon: Column) -> Column:
    return F.when(lon < 0, lon + 360.0).otherwise(lon)


def rotate(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(lon in [0, 360), lat) with the poles laid on the equator."""
    x, y, z = _cartesian(lon - 90.0, lat)
    a, b = _degrees(z, y, -x)
    return _wrapped(a + 90.0), b


def unrotate(lon: Column, lat: Column) -> tuple[Column, Column]:
    """The inverse of rotate, up to whole turns."""
    x, y, z = _cartesian(lon - 90.0, lat)
    a, b = _degrees(-z, y, x)
    return _wrapped(a + 90.0), b


def to_south_pole(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Turn the sphere by the rotation that takes the mirrored northern pole to the southern one."""
    m = south_matrix()
    v = _cartesian(lon, lat)
    return _degrees(*(sum((F.lit(c) * x for c, x in zip(row[1:], v[1:], strict=True)), F.lit(row[0]) * v[0]) for row in m))


def south_matrix() -> list[list[float]]:
    """Rodrigues' rotation matrix from (NORTH longitude, SOUTH latitude) to SOUTH."""

    def point(lon: float, lat: float) -> list[float]:
        a, b = math.radians(lon), math.radians(lat)
        return [math.cos(b) * math.cos(a), math.cos(b) * math.sin(a), math.sin(b)]

    p, q = point(NORTH[0], SOUTH[1]), point(*SOUTH)
    k = [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    sin, cos = math.sqrt(sum(x * x for x in k)), sum(x * y for x, y in zip(p, q, strict=True))
    k = [x / sin for x in k]
    cross = [[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]]
    return [[(i == j) * cos + (1 - cos) * k[i] * k[j] + sin * cross[i][j] for j in range(3)] for i in range(3)]


def shift(lat: Column) -> Column:
    """Latitude drawn 20° towards the equator (over it, for lower ones)."""
    return F.when(lat < 0, lat + SHIFT).otherwise(lat - SHIFT)


def unshift(lat: Column) -> Column:
    """The inverse of shift for latitudes of 20° and more."""
    return F.when(lat < 0, lat - SHIFT).otherwise(lat + SHIFT)
