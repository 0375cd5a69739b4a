"""Contour polygons of scores: rotation, density on a grid of degrees or parts of them, marching squares, rings and their holes.

The density grid has 360 x 180 / cell^2 cells at most whatever the input, so all that follows the first aggregation is small.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telluric.functions import rotations

WIDTH, HEIGHT, BANDWIDTH = 360, 180, 2.0


def weight(score: Column, power: bool = True) -> Column:
    """A score's weight in the density: to the power of 1.5, or as it is."""
    return F.pow(score, F.lit(1.5)) if power else score


def mirrored(scores: DataFrame) -> DataFrame:
    """scores (lon, lat, score) and their images on the southern hemisphere."""
    lon, lat = rotations.to_south_pole(F.col("lon"), -F.col("lat"))
    return scores.select("lon", "lat", "score").unionByName(scores.select(lon.alias("lon"), lat.alias("lat"), "score"))


def cells_of(cell: float) -> tuple[int, int]:
    """(columns, rows) of the grid with cells of so many degrees."""
    high = round(HEIGHT / cell) if cell > 0 else 0
    if not high or abs(high * cell - HEIGHT) > 1e-9:
        raise ValueError("cell divides 180 degrees")
    return 2 * high, high


def density(scores: DataFrame, *, power: bool = True, bandwidth: float = BANDWIDTH, cell: float = 1) -> DataFrame:
    """(x, y, density): the weights of the rotated points in cells of so many degrees, smoothed by a Gaussian of bandwidth degrees, 3 of them wide.

    cell divides 180 and may be a part of a degree. A cell's density is that of one degree squared. The Gaussian is the product of one along x and
    one along y, so rows are spread along x, added up, and then spread along y: twice 6 bandwidths / cell rows for each cell and not the square of that.
    """
    (wide, high), sigma = cells_of(cell), bandwidth / cell
    lon, lat = rotations.rotate(F.col("lon"), rotations.shift(F.col("lat")))
    cells = (
        scores.select(lon.alias("lon"), lat.alias("lat"), weight(F.col("score"), power).alias("w"))
        .where("NOT isnan(lon) AND NOT isnan(lat) AND NOT isnan(w) AND w > 0")
        .groupBy(F.least(F.floor(F.col("lon") / cell), F.lit(wide - 1)).alias("x"), F.least(F.floor((F.col("lat") + 90.0) / cell), F.lit(high - 1)).alias("y"))
        .agg(F.sum("w").alias("w"))
    )
    reach = math.ceil(3 * sigma)

    def spread(rows: DataFrame, name: str, most: int) -> DataFrame:
        kernel = F.exp(-(F.col("d") * F.col("d")) / (2.0 * sigma * sigma)) / (math.sqrt(2.0 * math.pi) * bandwidth)
        moved = rows.withColumn("d", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumns({name: F.col(name) + F.col("d"), "w": F.col("w") * kernel})
        return moved.where(f"{name} BETWEEN 0 AND {most - 1}").groupBy("x", "y").agg(F.sum("w").alias("w"))

    return spread(spread(cells, "x", wide), "y", high).withColumnRenamed("w", "density")


def even_thresholds(top: Column, n: int) -> Column:
    """About n round values above 0 up to top: multiples of 1, 2 or 5 times a power of ten."""
    rough = top / float(n)
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.when(rough > 0, rough))))
    error = rough / power
    step = power * F.when(error >= math.sqrt(50), 10.0).when(error >= math.sqrt(10), 5.0).when(error >= math.sqrt(2), 2.0).otherwise(1.0)
    k = F.floor(top / step).cast("int")
    return F.when(k > 0, F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: i * step)).otherwise(F.array().cast("array<double>"))


def segments(grid: DataFrame, thresholds: list[float] | int, shares: list[float] | None = None) -> DataFrame:
    """(value, x1, y1, x2, y2): marching squares between the cell centres of a density grid; cells that are missing have density 0.

    thresholds are densities, or about how many round ones there are to be; shares of the highest density may be given instead.
    The part above the threshold lies to the left of each segment. Saddles are cut as two corners.
    """
    corners = grid.withColumn("c", F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (0, 1) for dy in (0, 1)))))
    squares = corners.groupBy((F.col("x") - F.col("c.dx")).alias("x"), (F.col("y") - F.col("c.dy")).alias("y")).agg(
        *(F.coalesce(F.max(F.when((F.col("c.dx") == dx) & (F.col("c.dy") == dy), F.col("density"))), F.lit(0.0)).alias(f"d{dx}{dy}") for dx in (0, 1) for dy in (0, 1))
    )
    top = F.broadcast(grid.agg(F.max("density").alias("top")))  # one row
    if shares is not None:
        values = F.array(*(F.col("top") * F.lit(float(x)) for x in shares))
    elif isinstance(thresholds, int):
        values = even_thresholds(F.col("top"), thresholds)
    else:
        values = F.array(*map(F.lit, map(float, thresholds))) if thresholds else F.array().cast("array<double>")
    rows = squares.crossJoin(top).withColumn("value", F.explode(F.filter(values, lambda x: x > 0)))
    above = sum((F.when(F.col(f"d{dx}{dy}") >= F.col("value"), bit).otherwise(0) for (dx, dy), bit in zip(((0, 0), (1, 0), (1, 1), (0, 1)), (1, 2, 4, 8), strict=True)), F.lit(0))

    def cross(a: str, b: str) -> Column:
        return (F.col("value") - F.col(a)) / F.nullif(F.col(b) - F.col(a), F.lit(0.0))

    half = F.lit(0.5)
    edge = {
        "bottom": (F.col("x") + half + cross("d00", "d10"), F.col("y") + half),
        "right": (F.col("x") + 1.5, F.col("y") + half + cross("d10", "d11")),
        "top": (F.col("x") + half + cross("d01", "d11"), F.col("y") + 1.5),
        "left": (F.col("x") + half, F.col("y") + half + cross("d00", "d01")),
    }
    cases = {
        1: ["bottom left"], 2: ["right bottom"], 3: ["right left"], 4: ["top right"], 5: ["bottom left", "top right"], 6: ["top bottom"], 7: ["top left"],
        8: ["left top"], 9: ["bottom top"], 10: ["right bottom", "left top"], 11: ["right top"], 12: ["left right"], 13: ["bottom right"], 14: ["left bottom"],
    }
    out = None
    for code, lines in cases.items():
        made = F.array(*(F.struct(*(c.alias(n) for c, n in zip((*edge[a], *edge[b]), ("x1", "y1", "x2", "y2"), strict=True))) for a, b in map(str.split, lines)))
        out = F.when(F.col("code") == code, made) if out is None else out.when(F.col("code") == code, made)
    return rows.withColumn("code", above).where("code BETWEEN 1 AND 14").withColumn("s", F.explode(out)).select("value", "s.*")


def signed_area(ring: np.ndarray) -> float:
    """The area of a closed ring of (x, y), positive if it turns to the left."""
    x, y = (ring - ring[0]).T
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum()) / 2


def within(at: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """For each place whether it lies within a closed ring: a line from there to the right crosses it an odd number of times."""
    (x1, y1), (x2, y2) = ring[:-1].T, ring[1:].T
    x, y = at[:, :1], at[:, 1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        crosses = ((y1 > y) != (y2 > y)) & (x < x1 + (y - y1) / (y2 - y1) * (x2 - x1))
    return crosses.sum(axis=1) % 2 == 1


def nested(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Polygons, each an outer ring (turning to the left) and its holes: those that lie in it and in no smaller outer ring.

    Rings without area are left out. A hole may touch a ring at some vertices; the others decide, or the middles of its edges.
    """
    areas = [signed_area(r) for r in rings]
    outer = sorted((k for k, a in enumerate(areas) if a > 0), key=lambda k: areas[k])
    held: dict[int, list[np.ndarray]] = {k: [] for k in outer}
    corners = {k: (rings[k].min(axis=0), rings[k].max(axis=0)) for k in outer}
    for hole, area in zip(rings, areas, strict=True):
        if area >= 0:
            continue
        low, high = hole.min(axis=0), hole.max(axis=0)
        for k in outer:
            if areas[k] <= -area or (low < corners[k][0]).any() or (high > corners[k][1]).any():
                continue
            places = np.concatenate([hole[:-1], (hole[:-1] + hole[1:]) / 2])
            shared = (places[:, None, :] == rings[k][None, :-1, :]).all(axis=2).any(axis=1)
            free = places[~shared][:1]
            if len(free) and within(free, rings[k])[0]:
                held[k].append(hole)
                break
    return [[rings[k], *held[k]] for k in outer]


def _polygons(lines: pd.DataFrame) -> pd.DataFrame:
    """The polygons of one threshold's segments; each segment of a ring begins where the one before it ends."""
    key = lambda x, y: (round(x, 9), round(y, 9))
    following: dict[tuple, list] = {}
    for s in lines.sort_values(["x1", "y1", "x2", "y2"]).itertuples():
        following.setdefault(key(s.x1, s.y1), []).append(key(s.x2, s.y2))
    rings = []
    while following:
        start = next(iter(following))
        ring, at = [start], start
        while at in following:
            nxt = following[at].pop()
            if not following[at]:
                del following[at]
            ring.append(nxt)
            at = nxt
            if at == start:
                break
        rings.append(np.array(ring))
    found = [[r.tolist() for r in p] for p in nested(rings)]
    return pd.DataFrame({"value": [lines["value"].iloc[0]] * len(found), "polygon": range(len(found)), "rings": found})


RINGS = "array<array<array<double>>>"


def polygons(grid: DataFrame, thresholds: list[float] | int = 20, shares: list[float] | None = None) -> DataFrame:
    """(value, polygon, rings): the polygons of each threshold in cells of a density grid, each an outer ring and its holes; see segments.

    The segments of one threshold are brought together: the grid bounds them.
    """
    return segments(grid, thresholds, shares).groupBy("value").applyInPandas(_polygons, f"value double, polygon long, rings {RINGS}")


def ring_areas(found: DataFrame) -> DataFrame:
    """(value, polygon, hole, vertices, area, outer_area) of each ring of polygons, areas in cells; holes have negative ones."""

    def area(ring: Column) -> Column:
        n = F.size(ring) - 1
        parts = F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda a, b: a[0] * b[1] - b[0] * a[1])
        return F.aggregate(parts, F.lit(0.0), lambda x, y: x + y) / 2.0

    rows = found.select("value", "polygon", "rings", F.posexplode("rings").alias("n", "ring"))
    return rows.select("value", "polygon", (F.col("n") > 0).alias("hole"), (F.size("ring") - 1).alias("vertices"), area(F.col("ring")).alias("area"), area(F.col("rings")[0]).alias("outer_area"))


def contours(
    scores: DataFrame, thresholds: list[float] | int = 20, *, shares: list[float] | None = None, power: bool = True, mirror: bool = True, bandwidth: float = BANDWIDTH, cell: float = 1
) -> DataFrame:
    """(value, coordinates): a multipolygon of [lon, lat] for each threshold above 0 that the density reaches; see segments and density.

    Each polygon is its outer ring and then the rings of its holes.
    """
    grid = density(mirrored(scores) if mirror else scores, power=power, bandwidth=bandwidth, cell=cell)

    def place(p: Column) -> Column:
        lon, lat = rotations.unrotate(p[0] * float(cell), p[1] * float(cell) - 90.0)
        return F.array(lon, rotations.unshift(lat))

    placed = polygons(grid, thresholds, shares).withColumn("rings", F.transform("rings", lambda ring: F.transform(ring, place)))
    return placed.groupBy("value").agg(F.sort_array(F.collect_list(F.struct("polygon", "rings")))["rings"].alias("coordinates")).where("value > 0")
