"""Aurora scores as Column functions. NaN stays NaN until a score is encoded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from telluric.functions.sphere import flat_distance

#: Geomagnetic pole that scoring uses, in degrees.
POLE_LAT, POLE_LON = 80.9, -72.6

#: Cubic pieces of the auroral-zone weight, (upper end, cubic, square, linear, constant), the first from 0.
ZONE = (
    (2200.0, -2.0790e-11, -7.6000e-67, 5.5517e-4, 0.0),
    (2700.0, -7.3879e-10, 4.7388e-6, -9.8701e-3, 7.6452),
    (3300.0, 9.7750e-10, -9.1631e-6, 2.7665e-2, -26.136),
    (5000.0, -1.0080e-10, 1.5121e-6, -7.5632e-3, 12.615),
)
OUTSIDE = 0.3


def clamp(x: Column, low: float, high: float) -> Column:
    """x cut to [low, high]; NaN stays NaN."""
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def field_score(i: Column) -> Column:
    """Score 0 to 10 of a field of |i| nT: a logistic curve of its logarithm."""
    return clamp(22.81964 + (-0.05732817 - 22.81964) / (1.0 + F.pow(F.abs(i) / 1055.17, F.lit(0.8849212))), 0.0, 10.0)


def derivative_score(d: Column) -> Column:
    """Score of a change of |d| nT: 0 below 10, else a tenth, without upper limit."""
    return F.when(F.abs(d) < 10.0, 0.0).otherwise(F.abs(d) / 10.0)


def zone_weight(distance: Column) -> Column:
    """Weight by the distance to the geomagnetic pole; the pieces are meant for kilometres."""
    out = None
    low = 0.0
    for high, *c in ZONE:
        piece = c[0] * distance * distance * distance + c[1] * distance * distance + c[2] * distance + c[3]
        at = (distance >= low) & (distance <= high)
        out = F.when(at, piece) if out is None else out.when(at, piece)
        low = high
    return out.otherwise(OUTSIDE)


def zone_score(lat: Column, lon: Column, score: Column, unit: str = "m") -> Column:
    """The score weighted by the auroral zone. unit "m" gives the weight metres, "km" the kilometres that its pieces are made for."""
    if unit not in ("m", "km"):
        raise ValueError("unit is m or km")
    distance = flat_distance(lat, lon, F.lit(POLE_LAT), F.lit(POLE_LON))
    return score * zone_weight(distance if unit == "m" else distance / 1000.0)


def encode(score: Column, flag: int | Column = 0) -> Column:
    """16-bit code: thousandths of the score, 14 bits, then two flag bits; NaN has code 0 in its score bits."""
    cut = F.when(F.isnan(score), 0.0).otherwise(clamp(score, 0.0, 10.0))
    return F.shiftleft(F.round(cut * 1000.0).cast("int"), 2).bitwiseOR((F.lit(flag) if isinstance(flag, int) else flag).bitwiseAND(F.lit(3)))


def larger(a: Column, b: Column) -> Column:
    """The larger of two scores; NaN only if both are."""
    return F.greatest(F.nanvl(a, b), F.nanvl(b, a))
