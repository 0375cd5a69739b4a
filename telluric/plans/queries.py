"""Queries over the star schema's tables, one for each operator, and the same in SQL where SQL can express them.

Values are rounded alike on both sides, after scaling, as two math libraries differ in the last digits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telluric.functions import rotations, scores, sphere
from telluric.operators import contours, derivative, factors, farfield, field, grid, scoring
from telluric.plans import workload
from telluric.sources import regions
from telluric.sources.schemas import POINT_GRID, POLE_GRID
from telluric.sources.scratch import folder

#: One pole, and two that are near one another, for the closed forms.
ONE, NEAR = (65.013, -70.017), (61.013, -95.017)
TESLA = 1e15
SMALL = 1e-10
GAP = 21_600.0
BOX = ((52.0, 63.5), (-130.0, -55.0))


def _rounded(df: DataFrame, columns: list[str], digits: int = 6, scale: float = 1.0) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) * scale, digits) for c in columns})


def _near(df: DataFrame, columns: list[str], digits: int = 6, scale: float = 1.0) -> DataFrame:
    """As _rounded, in the arithmetic of doubles: quick enough for each pair. Ties, which go to the even digit here, don't occur."""
    return df.withColumns({c: F.rint(F.col(c) * (scale * 10.0**digits)) / 10.0**digits + 0.0 for c in columns})


def _pole(spark: SparkSession, at: tuple[float, float], n: int = 0) -> DataFrame:
    return spark.range(1).select(F.lit(n).cast("long").alias("pole_idx"), F.lit(at[0]).alias("lat"), F.lit(at[1]).alias("lon"))


def grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid's points with the number of stations next to each."""
    nodes = grid.geographical_grid(spark, *POINT_GRID)
    near = workload.points(spark, sf_dir).groupBy(grid.nearest_node(F.col("lat"), F.col("lon"), *POINT_GRID).alias("idx")).agg(F.count("*").alias("n"))
    return _rounded(nodes.join(near, "idx", "left").select("idx", "lat", "lon", F.coalesce("n", F.lit(0)).alias("n")), ["lat", "lon"])


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field.pairs(workload.points(spark, sf_dir), workload.poles(spark, sf_dir), ["point_idx"], ["pole_idx"], by_place=True)


def angular_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(_pairs(spark, sf_dir).select("point_idx", "pole_idx", "theta"), ["theta"])


def bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(_pairs(spark, sf_dir).select("point_idx", "pole_idx", "alpha"), ["alpha"])


def _transfer(spark: SparkSession, sf_dir: str, altitude: float, pole_altitude: float) -> DataFrame:
    rows = field.transfer_rows(workload.points(spark, sf_dir), altitude, workload.poles(spark, sf_dir), pole_altitude, ["point_idx"], ["pole_idx"], by_place=True)
    return _near(rows, ["t_i", "t_j", "t_k"], scale=TESLA)


def transfer_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transfer(spark, sf_dir, 0.0, 110e3)


def transfer_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transfer(spark, sf_dir, 400e3, 110e3)


def obs_zero_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(field.without_k(workload.observations(spark, sf_dir)), ["lat", "lon", "i", "j", "k"])


def obs_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(field.flattened(field.without_k(workload.observations(spark, sf_dir))), ["value"])


def _single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field.fit_single_pole(field.without_k(workload.observations(spark, sf_dir)), _pole(spark, ONE))


def fit_single_pole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_single(spark, sf_dir), ["amp"], 3, 1e-9)


def fit_two_pole(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = field.fit_two_poles(field.without_k(workload.observations(spark, sf_dir)), _pole(spark, ONE), _pole(spark, NEAR))
    return _rounded(fitted, ["amp_a", "amp_b"], 3, 1e-9)


def fit_multi_pole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(field.fit(field.without_k(workload.observations(spark, sf_dir)), workload.poles(spark, sf_dir)), ["amp"], 3, 1e-9)


def _two_poles(spark: SparkSession) -> DataFrame:
    return _pole(spark, ONE).union(_pole(spark, NEAR, 1))


def fit_small_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two poles by the general fit, with a cutoff that singular values themselves are needed for."""
    return _near(field.fit(field.without_k(workload.observations(spark, sf_dir)), _two_poles(spark), cutoff=SMALL), ["amp"], 3, 1e-9)


def pseudo_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pseudo-inverse of each frame's matrix at two poles: weights of every row."""
    rows = field.transfer_rows(workload.observations(spark, sf_dir), 0.0, _two_poles(spark), 110e3, ["frame_id", "obs_idx"], ["pole_idx"])
    both = rows.groupBy("frame_id", "obs_idx").agg(*(F.array(*(F.max(F.when(F.col("pole_idx") == n, F.col(c))) * TESLA for n in (0, 1))).alias(c) for c in ("t_i", "t_j", "t_k")))
    flat = both.select("frame_id", F.col("obs_idx"), F.posexplode(F.array("t_i", "t_j", "t_k")).alias("pos", "cells"))
    found = factors.inverse_rows(flat.select(F.col("frame_id").alias("set_id"), (F.col("obs_idx") * 3 + F.col("pos")).alias("row"), "cells"), 0.1)
    out = found.select(F.col("set_id").cast("long").alias("frame_id"), "row", F.col("weights")[0].alias("weight_a"), F.col("weights")[1].alias("weight_b"))
    return _near(out, ["weight_a", "weight_b"], 3, 1e9)


def fit_predict_two_pole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field of two poles, fitted by frame, at all points through the bases of the fit."""
    fitted = field.fitted(field.without_k(workload.observations(spark, sf_dir)), _two_poles(spark))
    return _near(fitted.predict(workload.points(spark, sf_dir)).drop("lat", "lon"), ["i", "j", "k"], 4)


def fit_predict_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standard setting at its full size: 2,500 poles fitted to all stations as one frame, the field at 4,810 points, scores and codes."""
    observations = field.without_k(workload.observations(spark, sf_dir)).withColumn("frame_id", F.lit(1).cast("long"))
    poles = grid.geographical_grid(spark, *POLE_GRID).withColumnRenamed("idx", "pole_idx")
    points = grid.geographical_grid(spark, *POINT_GRID).withColumnRenamed("idx", "point_idx")
    scored = scoring.zone_weighted(scoring.into_scores(field.fitted(observations, poles).predict(points)))
    return scored.select("frame_id", "point_idx", "lat", "lon", "i", "j", "k", "score", scores.encode(F.col("score")).alias("code"))


def derivative_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How fast the components change at each station that was heard within six hours before, per minute."""
    found = derivative.derivatives(workload.observations(spark, sf_dir, also=("ts",)), gap=GAP)
    return _near(found.select("frame_id", "obs_idx", "i", "j", "k"), ["i", "j", "k"])


def _fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions from amplitudes that are given by the poles' numbers."""
    poles = workload.poles(spark, sf_dir)
    amplitudes = poles.select(F.lit(1).cast("long").alias("frame_id"), "pole_idx", ((F.col("pole_idx") * 7919 % 2001 - 1000) * 1e11).alias("amp"))
    return field.predict(workload.points(spark, sf_dir), poles, amplitudes)


def predict_fixed_amps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_fixed(spark, sf_dir), ["lat", "lon", "i", "j", "k"], 4).drop("frame_id")


def predict_far_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As predict_fixed_amps, by cells of poles."""
    poles = workload.poles(spark, sf_dir)
    amplitudes = poles.select(F.lit(1).cast("long").alias("frame_id"), "pole_idx", ((F.col("pole_idx") * 7919 % 2001 - 1000) * 1e11).alias("amp"))
    found = farfield.predict_far(workload.points(spark, sf_dir), poles, amplitudes, nodes=16)
    return _near(found, ["lat", "lon", "i", "j", "k"], 4).drop("frame_id")


def predict_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """predict_fixed_amps for the points of a box, from points stored by cell: the files of other cells are not read."""
    path, poles = f"{folder(spark)}/points", workload.poles(spark, sf_dir)
    regions.write_cells(workload.points(spark, sf_dir), path)
    amplitudes = poles.select(F.lit(1).cast("long").alias("frame_id"), "pole_idx", ((F.col("pole_idx") * 7919 % 2001 - 1000) * 1e11).alias("amp"))
    found = field.predict(regions.read_region(spark, path, *BOX), poles, amplitudes)
    return _near(found, ["lat", "lon", "i", "j", "k"], 4).drop("frame_id")


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field of one pole, fitted by frame, at all points."""
    return field.predict(workload.points(spark, sf_dir), _pole(spark, ONE), _single(spark, sf_dir))


def fit_predict_single_pole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: fit by frame, predict, score, weight, encode."""
    scored = scoring.zone_weighted(scoring.into_scores(_near(_predicted(spark, sf_dir), ["i", "j", "k"])))
    out = _near(scored, ["score"], 5).withColumn("code", scores.encode(F.floor(F.col("score") * 100.0 + 0.5) / 100.0))
    return out.select("frame_id", "point_idx", "i", "j", "k", "score", "code")


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations as if they were predictions."""
    return workload.observations(spark, sf_dir).select("obs_idx", "lat", "lon", "i")


def score_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.into_scores(_values(spark, sf_dir)).select("obs_idx", "score"), ["score"])


def score_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.into_scores(_values(spark, sf_dir), derivative=True).select("obs_idx", "score"), ["score"])


def _pole_distance() -> Column:
    return sphere.flat_distance(F.col("lat"), F.col("lon"), F.lit(scores.POLE_LAT), F.lit(scores.POLE_LON))


def approx_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.points(spark, sf_dir).select("point_idx", F.round(_pole_distance(), 4).alias("distance"))


def auroral_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of metres and of kilometres."""
    d = _pole_distance()
    return workload.points(spark, sf_dir).select("point_idx", F.round(scores.zone_weight(d), 6).alias("by_m"), F.round(scores.zone_weight(d / 1000.0), 6).alias("by_km"))


def score_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.zone_weighted(scoring.into_scores(_values(spark, sf_dir)), "km").select("obs_idx", "score"), ["score"])


def encode_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _rounded(scoring.into_scores(_values(spark, sf_dir)), ["score"], 2)
    return scoring.encoded(scored, ["obs_idx"])


def merge_max_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _values(spark, sf_dir)
    merged = scoring.merged(scoring.into_scores(values), scoring.into_scores(values, derivative=True), ["obs_idx"])
    return _rounded(merged, ["lat", "lon", "score"])


def _rotation(spark: SparkSession, sf_dir: str, turn) -> DataFrame:
    lon, lat = turn(F.col("lon"), F.col("lat"))
    return workload.points(spark, sf_dir).select("point_idx", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


def contour_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rotation(spark, sf_dir, rotations.rotate)


def contour_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rotation(spark, sf_dir, rotations.unrotate)


def _scored_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lon, lat, score): points with a score by their numbers."""
    return workload.points(spark, sf_dir).select("point_idx", "lon", "lat", (F.col("point_idx") * 13 % 101 / 10.0).alias("score"))


def contour_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(contours.mirrored(_scored_points(spark, sf_dir)), ["lon", "lat", "score"])


def contour_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_points(spark, sf_dir).select(
        "point_idx", F.round(contours.weight(F.col("score")), 6).alias("weight"), F.round(rotations.shift(F.col("lat")), 6).alias("shifted"),
        F.round(rotations.unshift(rotations.shift(F.col("lat"))), 6).alias("lat"),
    )


def contour_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(contours.density(contours.mirrored(_scored_points(spark, sf_dir))), ["density"])


def contour_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons at five shares of the highest density."""
    return contours.contours(_scored_points(spark, sf_dir), shares=[k / 6 for k in range(1, 6)])


def contour_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ring of those polygons in the density grid: whether it is a hole, its vertices, its area, and that of the outer ring it belongs to."""
    found = contours.polygons(contours.density(contours.mirrored(_scored_points(spark, sf_dir))), shares=[k / 6 for k in range(1, 6)])
    return _rounded(contours.ring_areas(found).drop("polygon"), ["value", "area", "outer_area"], 5)


QUERIES = {
    f.__name__: f
    for f in (
        grid_points, angular_distance, bearing, transfer_under, transfer_over, obs_zero_k, obs_flatten, fit_single_pole, fit_two_pole, fit_multi_pole, fit_small_cutoff, pseudo_inverse, fit_predict_two_pole, fit_predict_grid,
        predict_fixed_amps, predict_far_field, predict_region, fit_predict_single_pole, derivative_vectors, score_abs, score_derivative, approx_distance, auroral_weight, score_weighted, encode_scores,
        merge_max_scores, contour_rotate, contour_invert, contour_mirror, contour_weight, contour_density, contour_polygons, contour_rings,
    )
}


# The same in SQL.


def _d(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _place(key: str, a: int, b: int, c: int, d: int, lat: float, lon: float) -> str:
    return f"{_d(lat)} + ({key} * {a} % {b}) / {_d(10.0)} AS lat, {_d(lon)} + ({key} * {c} % {d}) / {_d(10.0)} AS lon"


POINTS = f"SELECT c_custkey AS point_idx, {_place('c_custkey', 37, 401, 91, 2051, 45.0, -170.0)} FROM customer"
POLES = f"SELECT s_suppkey AS pole_idx, {_place('s_suppkey', 53, 397, 71, 2043, 45.013, -170.017)} FROM supplier"
OBS = f"""SELECT day(ts) AS frame_id, event_id AS obs_idx, {_place('user_id', 37, 401, 91, 2051, 45.0, -170.0)},
          (1 - 2 * (event_id % 2)) * value AS i, (1 - 2 * (event_id % 2)) * value * {_d(-0.5)} AS j, value * {_d(0.25)} AS k FROM events"""
RADIUS = _d(6371e3)


def _angles(a: str = "p", b: str = "s") -> str:
    """theta and alpha of the places of two aliases."""
    d = f"(radians({b}.lon) - radians({a}.lon))"
    pa, pb = f"radians({a}.lat)", f"radians({b}.lat)"
    return (
        f"acos(sin({pa}) * sin({pb}) + cos({pa}) * cos({pb}) * cos({d})) AS theta, "
        f"pi() / 2 - atan2(cos({pb}) * sin({d}), cos({pa}) * sin({pb}) - sin({pa}) * cos({pb}) * cos({d})) AS alpha"
    )


def _t(altitude: float, pole_altitude: float) -> str:
    """t_i, t_j, t_k from theta and alpha."""
    r, s = altitude + 6371e3, pole_altitude + 6371e3
    m, above = 1e-7 / r, altitude > pole_altitude
    x = s / r if above else r / s
    f = f"(1 / sqrt(1 - {_d(2 * x)} * cos(theta) + {_d(x * x)}))"
    radial = f"{_d(m * x if above else m)} * ({f} - 1)"
    along = (
        f"{_d(-m)} * (({_d(r)} - {_d(s)} * cos(theta)) / sqrt({_d(r * r)} - {_d(2 * r * s)} * cos(theta) + {_d(s * s)}) - 1)"
        if above
        else f"{_d(-m)} * ({f} * ({_d(x)} - cos(theta)) + cos(theta))"
    )
    zero = "CASE WHEN sin(theta) = 0 THEN 0 ELSE"
    return f"{zero} -({along}) / sin(theta) * sin(alpha) END AS t_i, {zero} -({along}) / sin(theta) * cos(alpha) END AS t_j, {zero} -({radial}) END AS t_k"


def _transfer_sql(altitude: float, pole_altitude: float) -> str:
    return f"""WITH p AS ({POINTS}), s AS ({POLES}), a AS (SELECT point_idx, pole_idx, {_angles()} FROM p, s), t AS (SELECT point_idx, pole_idx, {_t(altitude, pole_altitude)} FROM a)
        SELECT point_idx, pole_idx, round(t_i * {_d(1e15)}, 6) AS t_i, round(t_j * {_d(1e15)}, 6) AS t_j, round(t_k * {_d(1e15)}, 6) AS t_k FROM t"""


def _column(at: tuple[float, float], name: str) -> str:
    """Observations with the transfer components of one pole."""
    return f"""{name}a AS (SELECT o.*, {_angles('o', 's')} FROM o, (SELECT {_d(at[0])} AS lat, {_d(at[1])} AS lon) AS s),
        {name} AS (SELECT frame_id, obs_idx, i, j, {_t(0.0, 110e3)} FROM {name}a)"""


SINGLE = f"o AS ({OBS}), {_column(ONE, 't')}, fit AS (SELECT frame_id, sum(t_i * i + t_j * j) / sum(t_i * t_i + t_j * t_j + t_k * t_k) AS amp FROM t GROUP BY frame_id)"


def _clamp(x: str) -> str:
    return f"least(greatest({x}, 0), 10)"


def _field_score(i: str) -> str:
    return _clamp(f"{_d(22.81964)} + ({_d(-0.05732817)} - {_d(22.81964)}) / (1 + pow(abs({i}) / {_d(1055.17)}, {_d(0.8849212)}))")


def _derivative_score(i: str) -> str:
    return f"CASE WHEN abs({i}) < 10 THEN 0 ELSE abs({i}) / {_d(10.0)} END"


def _flat(lat: str = "lat", lon: str = "lon") -> str:
    x = f"((radians({_d(scores.POLE_LON)}) - radians({lon})) * cos((radians({lat}) + radians({_d(scores.POLE_LAT)})) / 2))"
    y = f"(radians({lat}) - radians({_d(scores.POLE_LAT)}))"
    return f"(sqrt({x} * {x} + {y} * {y}) * {RADIUS})"


def _zone(d: str) -> str:
    low, out = 0.0, "CASE"
    for high, a, b, c, e in scores.ZONE:
        out += f" WHEN {d} BETWEEN {_d(low)} AND {_d(high)} THEN {_d(a)} * {d} * {d} * {d} + {_d(b)} * {d} * {d} + {_d(c)} * {d} + {_d(e)}"
        low = high
    return out + f" ELSE {_d(scores.OUTSIDE)} END"


def _code(score: str) -> str:
    return f"CAST(round({_clamp(score)} * {_d(1000.0)}) AS INTEGER) * 4"


def _turned(lon: str, lat: str, back: bool) -> tuple[str, str]:
    """rotate or unrotate."""
    a, b = f"radians(({lon}) - 90)", f"radians({lat})"
    x, y, z = f"(cos({b}) * cos({a}))", f"(cos({b}) * sin({a}))", f"sin({b})"
    u, w = (f"-{z}", x) if back else (z, f"-{x}")
    out = f"(degrees(atan2({y}, {u})) + 90)"
    return f"CASE WHEN {out} < 0 THEN {out} + 360 ELSE {out} END", f"degrees(asin(greatest(-1, least(1, {w}))))"


def _rotation_sql(back: bool) -> str:
    lon, lat = _turned("lon", "lat", back)
    return f"WITH p AS ({POINTS}) SELECT point_idx, round({lon}, 6) AS lon, round({lat}, 6) AS lat FROM p"


SCORED = f"SELECT point_idx, lon, lat, point_idx * 13 % 101 / {_d(10.0)} AS score FROM ({POINTS})"
SHIFT = "CASE WHEN {0} < 0 THEN {0} + 20 ELSE {0} - 20 END"


def _mirrored_sql() -> str:
    v = ("cos(radians(-lat)) * cos(radians(lon))", "cos(radians(-lat)) * sin(radians(lon))", "sin(radians(-lat))")
    x, y, z = (reduce(lambda a, b: f"{a} + {b}", (f"{_d(c)} * {e}" for c, e in zip(row, v, strict=True))) for row in rotations.south_matrix())
    return f"SELECT lon, lat, score FROM q UNION ALL SELECT degrees(atan2({y}, {x})), degrees(asin(greatest(-1, least(1, {z})))), score FROM q"


def _density_sql(density: str = "round({}, 6)") -> str:
    lon, lat = _turned("lon", SHIFT.format("lat"), False)
    k = "exp(-(dx * dx + dy * dy) / CAST(8 AS DOUBLE)) / (CAST(8 AS DOUBLE) * pi())"
    return f"""WITH q AS ({SCORED}), m AS ({_mirrored_sql()}), r AS (SELECT {lon} AS lon, {lat} AS lat, pow(score, 1.5) AS w FROM m WHERE score > 0),
        c AS (SELECT least(CAST(floor(lon) AS BIGINT), 359) AS cx, least(CAST(floor(lat + 90) AS BIGINT), 179) AS cy, sum(w) AS w FROM r GROUP BY ALL)
        SELECT cx + dx AS x, cy + dy AS y, {density.format(f'sum(w * {k})')} AS density
        FROM c, generate_series(-6, 6) AS a(dx), generate_series(-6, 6) AS b(dy)
        WHERE cx + dx BETWEEN 0 AND 359 AND cy + dy BETWEEN 0 AND 179 GROUP BY ALL"""


def _rings_sql(doublings: int = 14) -> str:
    """Marching squares over the density; a segment's ring is the smallest number among the segments that follow it, found by doubling (2^doublings of them at most)."""
    corner = "(SELECT density FROM g WHERE g.x = s.x + {} AND g.y = s.y + {})"
    at = {
        "b": "(x + 0.5 + (value - d00) / (d10 - d00), y + 0.5)", "r": "(x + 1.5, y + 0.5 + (value - d10) / (d11 - d10))",
        "t": "(x + 0.5 + (value - d01) / (d11 - d01), y + 1.5)", "l": "(x + 0.5, y + 0.5 + (value - d00) / (d01 - d00))",
    }
    cases = {1: "bl", 2: "rb", 3: "rl", 4: "tr", 5: "bltr", 6: "tb", 7: "tl", 8: "lt", 9: "bt", 10: "rblt", 11: "rt", 12: "lr", 13: "br", 14: "lb"}

    def line(a: str, b: str) -> str:
        (ax, ay), (bx, by) = (p[1:-1].rsplit(", ", 1) for p in (at[a], at[b]))
        return "{" + f"'x1': round({ax}, 9), 'y1': round({ay}, 9), 'x2': round({bx}, 9), 'y2': round({by}, 9)" + "}"

    lines = " ".join(f"WHEN {code} THEN [{', '.join(line(*edges[k : k + 2]) for k in range(0, len(edges), 2))}]" for code, edges in cases.items())
    doubled = "".join(
        f""", n{k + 1} AS MATERIALIZED (SELECT a.id, least(a.ring, b.ring) AS ring, b.nxt FROM n{k} AS a JOIN n{k} AS b ON b.id = a.nxt)""" for k in range(doublings)
    )
    return f"""WITH g AS MATERIALIZED (SELECT x, y, density FROM ({_density_sql("{}")})),
        s AS (SELECT DISTINCT x - dx AS x, y - dy AS y FROM g, generate_series(0, 1) AS a(dx), generate_series(0, 1) AS b(dy)),
        d AS (SELECT x, y, {', '.join(f"coalesce({corner.format(*k)}, 0) AS d{k}" for k in ('00', '10', '11', '01'))} FROM s),
        v AS (SELECT d.*, top * {_d(1.0)} * k / 6 AS value FROM d, (SELECT max(density) AS top FROM g), generate_series(1, 5) AS c(k)),
        e AS (SELECT *, (d00 >= value)::INT + 2 * (d10 >= value)::INT + 4 * (d11 >= value)::INT + 8 * (d01 >= value)::INT AS code FROM v),
        u AS (SELECT value, unnest(CASE code {lines} END, recursive := true) FROM e WHERE code BETWEEN 1 AND 14),
        l AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY value, x1, y1) AS id FROM u),
        n0 AS MATERIALIZED (SELECT a.id, a.id AS ring, b.id AS nxt FROM l AS a JOIN l AS b ON a.value = b.value AND a.x2 = b.x1 AND a.y2 = b.y1){doubled},
        q AS MATERIALIZED (SELECT l.*, ring FROM l JOIN n{doublings} USING (id)),
        z AS (SELECT value, ring, count(*) AS vertices, sum(x1 * y2 - x2 * y1) / 2 AS area, arg_min(x1, id) AS x, arg_min(y1, id) AS y FROM q GROUP BY value, ring),
        i AS (SELECT h.ring, o.ring AS outside, any_value(o.area) AS area
              FROM z AS h JOIN z AS o ON h.value = o.value AND h.area < 0 AND o.area > 0 JOIN q ON q.value = o.value AND q.ring = o.ring
              WHERE (q.y1 > h.y) <> (q.y2 > h.y) AND h.x < q.x1 + (h.y - q.y1) / (q.y2 - q.y1) * (q.x2 - q.x1)
              GROUP BY h.ring, o.ring HAVING count(*) % 2 = 1),
        m AS (SELECT ring, min(area) AS outer_area FROM i GROUP BY ring)
        SELECT round(value, 5) AS value, area < 0 AS hole, CAST(vertices AS INTEGER) AS vertices, round(area, 5) AS area, round(coalesce(outer_area, area), 5) AS outer_area FROM z LEFT JOIN m USING (ring)"""


def _two_pole_ctes(cutoff: float = 0.1) -> str:
    """Up to f: by frame the sums over both columns and the observations, and the eigenvalues."""
    both = "u AS MATERIALIZED (SELECT t.frame_id, obs_idx, t.i, t.j, t.t_i AS ai, t.t_j AS aj, t.t_k AS ak, w.t_i AS bi, w.t_j AS bj, w.t_k AS bk FROM t JOIN w USING (frame_id, obs_idx))"
    s = _d(1e30)
    return f"""WITH o AS ({OBS}), {_column(ONE, 't')}, {_column(NEAR, 'w')}, {both},
        g AS (SELECT frame_id, sum((ai * ai + aj * aj + ak * ak) * {s}) AS p, sum((bi * bi + bj * bj + bk * bk) * {s}) AS r, sum((ai * bi + aj * bj + ak * bk) * {s}) AS q,
                     sum((ai * i + aj * j) * {_d(1e15)}) AS x, sum((bi * i + bj * j) * {_d(1e15)}) AS y FROM u GROUP BY frame_id),
        e AS (SELECT *, (p + r) / 2 + sqrt(((p - r) / 2) ** 2 + q * q) AS l1, (p + r) / 2 - sqrt(((p - r) / 2) ** 2 + q * q) AS l2 FROM g),
        f AS (SELECT *, CASE WHEN l2 >= {_d(cutoff * cutoff)} * l1 THEN 1 / l2 ELSE 0 END AS keep, p * x + q * y AS gx, q * x + r * y AS gy FROM e)"""


def _inverse(v: str, gv: str) -> str:
    """One component of the inverse, on the kept space, times a vector with that component v; gv: of the Gram matrix times it."""
    return f"((({gv}) - l2 * {v}) / (l1 - l2) / l1 + (l1 * {v} - ({gv})) / (l1 - l2) * keep)"


def _two_pole_sql(cutoff: float = 0.1) -> str:
    amp = f"* {_d(1e15)} * {_d(1e-9)}"
    return f"{_two_pole_ctes(cutoff)} SELECT frame_id, round({_inverse('x', 'gx')} {amp}, 3) AS amp_a, round({_inverse('y', 'gy')} {amp}, 3) AS amp_b FROM f"


def _inverse_rows_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT frame_id, obs_idx * 3 + {n} AS row, a{c} * {_d(1e15)} AS a, b{c} * {_d(1e15)} AS b FROM u" for n, c in enumerate("ijk"))
    return f"""{_two_pole_ctes()}, c AS ({rows}) SELECT frame_id, row, round({_inverse('a', 'p * a + q * b')} * {_d(1e9)}, 3) AS weight_a,
        round({_inverse('b', 'q * a + r * b')} * {_d(1e9)}, 3) AS weight_b FROM c JOIN f USING (frame_id)"""


def _predict_two_pole_sql() -> str:
    at = " UNION ALL ".join(f"SELECT {n} AS pole_idx, {_d(x)} AS lat, {_d(y)} AS lon" for n, (x, y) in enumerate((ONE, NEAR)))
    return f"""{_two_pole_ctes()}, pt AS ({POINTS}), pa AS (SELECT point_idx, pole_idx, {_angles('pt')} FROM pt, ({at}) AS s), k AS (SELECT point_idx, pole_idx, {_t(110e3, 110e3)} FROM pa),
        amp AS (SELECT frame_id, 0 AS pole_idx, {_inverse('x', 'gx')} * {_d(1e15)} AS amp FROM f UNION ALL SELECT frame_id, 1, {_inverse('y', 'gy')} * {_d(1e15)} FROM f)
        SELECT frame_id, point_idx, round(sum(amp * t_i), 4) AS i, round(sum(amp * t_j), 4) AS j, round(sum(amp * t_k), 4) AS k FROM amp JOIN k USING (pole_idx) GROUP BY frame_id, point_idx"""


def _fixed_sql(where: str = "") -> str:
    return f"""WITH p AS (SELECT * FROM ({POINTS}) {where}), s AS ({POLES}), a AS (SELECT point_idx, p.lat, p.lon, (pole_idx * 7919 % 2001 - 1000) * {_d(1e11)} AS amp, {_angles()} FROM p, s),
        t AS (SELECT point_idx, lat, lon, amp, {_t(110e3, 110e3)} FROM a)
        SELECT point_idx, round(lat, 4) AS lat, round(lon, 4) AS lon, round(sum(amp * t_i), 4) AS i, round(sum(amp * t_j), 4) AS j, round(sum(amp * t_k), 4) AS k FROM t GROUP BY point_idx, lat, lon"""


ORACLE_SQL = {
    "grid_points": f"""WITH p AS ({POINTS}), n AS (
            SELECT CAST(least(greatest(round((lat - 45) / {_d((85.0 - 45.0) / 36)}), 0), 36) AS BIGINT) * 130
                 + CAST(least(greatest(round((lon + 180) / {_d((179.0 + 180.0) / 129)}), 0), 129) AS BIGINT) AS idx, count(*) AS n FROM p GROUP BY 1)
        SELECT g.idx, round(45 + (g.idx // 130) * {_d((85.0 - 45.0) / 36)}, 6) AS lat, round(-180 + (g.idx % 130) * {_d((179.0 + 180.0) / 129)}, 6) AS lon, coalesce(n, 0) AS n
        FROM generate_series(0, 4809) AS g(idx) LEFT JOIN n USING (idx)""",
    "angular_distance": f"WITH p AS ({POINTS}), s AS ({POLES}), a AS (SELECT point_idx, pole_idx, {_angles()} FROM p, s) SELECT point_idx, pole_idx, round(theta, 6) AS theta FROM a",
    "bearing": f"WITH p AS ({POINTS}), s AS ({POLES}), a AS (SELECT point_idx, pole_idx, {_angles()} FROM p, s) SELECT point_idx, pole_idx, round(alpha, 6) AS alpha FROM a",
    "transfer_under": _transfer_sql(0.0, 110e3),
    "transfer_over": _transfer_sql(400e3, 110e3),
    "obs_zero_k": f"SELECT frame_id, obs_idx, round(lat, 6) AS lat, round(lon, 6) AS lon, round(i, 6) AS i, round(j, 6) AS j, {_d(0.0)} AS k FROM ({OBS})",
    "obs_flatten": f"""WITH o AS ({OBS}) SELECT frame_id, obs_idx * 3 AS row, round(i, 6) AS value FROM o
        UNION ALL SELECT frame_id, obs_idx * 3 + 1, round(j, 6) FROM o UNION ALL SELECT frame_id, obs_idx * 3 + 2, {_d(0.0)} FROM o""",
    "fit_single_pole": f"WITH {SINGLE} SELECT frame_id, CAST(0 AS BIGINT) AS pole_idx, round(amp * {_d(1e-9)}, 3) AS amp FROM fit",
    "fit_two_pole": _two_pole_sql(),
    "fit_small_cutoff": " UNION ALL ".join(f"SELECT frame_id, CAST({n} AS BIGINT) AS pole_idx, amp_{c} AS amp FROM ({_two_pole_sql(SMALL)})" for n, c in enumerate("ab")),
    "pseudo_inverse": _inverse_rows_sql(),
    "fit_predict_two_pole": _predict_two_pole_sql(),
    "predict_fixed_amps": _fixed_sql(),
    "predict_far_field": _fixed_sql(),
    "predict_region": _fixed_sql(f"WHERE lat BETWEEN {BOX[0][0]} AND {BOX[0][1]} AND lon BETWEEN {BOX[1][0]} AND {BOX[1][1]}"),
    "fit_predict_single_pole": f"""WITH {SINGLE}, p AS ({POINTS}), pa AS (SELECT point_idx, p.lat, p.lon, {_angles()} FROM p, (SELECT {_d(ONE[0])} AS lat, {_d(ONE[1])} AS lon) AS s),
        pt AS (SELECT point_idx, lat, lon, {_t(110e3, 110e3)} FROM pa),
        v AS (SELECT frame_id, point_idx, lat, lon, round(amp * t_i, 6) AS i, round(amp * t_j, 6) AS j, round(amp * t_k, 6) AS k FROM fit, pt),
        z AS (SELECT *, round({_field_score('i')} * ({_zone(_flat())}), 5) AS score FROM v)
        SELECT frame_id, point_idx, i, j, k, score, {_code('round(score, 2)')} AS code FROM z""",
    "derivative_vectors": f"""WITH o AS ({OBS.replace('SELECT', 'SELECT ts,', 1)}),
        a AS (SELECT lat, lon, ts, min(frame_id) AS frame_id, min(obs_idx) AS obs_idx, avg(i) AS i, avg(j) AS j, avg(k) AS k FROM o GROUP BY lat, lon, ts),
        b AS (SELECT *, last_value(ts) OVER w AS t0, last_value(i) OVER w AS i0, last_value(j) OVER w AS j0, last_value(k) OVER w AS k0 FROM a
              WINDOW w AS (PARTITION BY lat, lon ORDER BY epoch_us(ts) RANGE BETWEEN {round(GAP * 1e6)} PRECEDING AND 1 PRECEDING)),
        c AS (SELECT *, (epoch_us(ts) - epoch_us(t0)) / {_d(60e6)} AS minutes FROM b WHERE t0 IS NOT NULL)
        SELECT frame_id, obs_idx, round((i - i0) / minutes, 6) AS i, round((j - j0) / minutes, 6) AS j, round((k - k0) / minutes, 6) AS k FROM c""",
    "score_abs": f"SELECT obs_idx, round({_field_score('i')}, 6) AS score FROM ({OBS})",
    "score_derivative": f"SELECT obs_idx, round({_derivative_score('i')}, 6) AS score FROM ({OBS})",
    "approx_distance": f"SELECT point_idx, round({_flat()}, 4) AS distance FROM ({POINTS})",
    "auroral_weight": f"WITH d AS (SELECT point_idx, {_flat()} AS d FROM ({POINTS})) SELECT point_idx, round({_zone('d')}, 6) AS by_m, round({_zone('(d / 1000)')}, 6) AS by_km FROM d",
    "score_weighted": f"WITH d AS (SELECT obs_idx, i, {_flat()} / 1000 AS d FROM ({OBS})) SELECT obs_idx, round({_field_score('i')} * ({_zone('d')}), 6) AS score FROM d",
    "encode_scores": f"SELECT obs_idx, {_code(f'round({_field_score("i")}, 2)')} AS code FROM ({OBS})",
    "merge_max_scores": f"""SELECT obs_idx, round(lat, 6) AS lat, round(lon, 6) AS lon, round(greatest({_field_score('i')}, {_derivative_score('i')}), 6) AS score
        FROM ({OBS})""",
    "contour_rotate": _rotation_sql(False),
    "contour_invert": _rotation_sql(True),
    "contour_mirror": f"WITH q AS ({SCORED}), m AS ({_mirrored_sql()}) SELECT round(lon, 6) AS lon, round(lat, 6) AS lat, round(score, 6) AS score FROM m",
    "contour_weight": f"SELECT point_idx, round(pow(score, 1.5), 6) AS weight, round({SHIFT.format('lat')}, 6) AS shifted, round(lat, 6) AS lat FROM ({SCORED})",
    "contour_density": _density_sql(),
    "contour_rings": _rings_sql(),
}
