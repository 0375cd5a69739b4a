import math
import time

import numpy as np
import pandas as pd
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from telluric.functions import rotations, scores
from telluric.operators import contours, derivative, factors, field, grid, scoring
from telluric.plans import queries
from telluric.plans.engine import Engine, NotFitted
from telluric.sources.schemas import POINT_GRID, POLE_GRID
from telluric.sources.store import Store

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF)


def places(spark, rows, key):
    return spark.createDataFrame([(n, float(a), float(b)) for n, (a, b) in enumerate(rows)], f"{key} long, lat double, lon double")


def observations(spark, rows):
    return spark.createDataFrame([(1, n, *map(float, r)) for n, r in enumerate(rows)], "frame_id long, obs_idx long, lat double, lon double, i double, j double, k double")


def test_linspace_and_grid(spark):
    assert [r.value for r in grid.linspace(spark, 0.0, 1.0, 5).orderBy("idx").collect()] == [0, 0.25, 0.5, 0.75, 1]
    assert grid.linspace(spark, 0.0, 1.0, 0).count() == 0
    assert [r.value for r in grid.linspace(spark, 3.0, 4.0, 1).collect()] == [3.0]
    with pytest.raises(ValueError):
        grid.linspace(spark, 1.0, 0.0, 5)
    g = grid.geographical_grid(spark, (0.0, 90.0), 3, (0.0, 180.0), 2).orderBy("idx").collect()
    assert len(g) == 6 and tuple(g[0]) == (0, 0, 0) and tuple(g[5]) == (5, 90, 180)


@pytest.mark.parametrize(
    "a, b, theta, alpha",
    [((0, 0), (0, 90), 1.5708, 0), ((0, 0), (90, 0), 1.5708, 1.5708), ((40.71, -74), (48.85, 2.35), 0.9162, 0.6333), ((34.05, -118.2), (48.85, 2.35), 1.4258, 0.961), ((90, 0), (-90, 0), 3.1416, -1.5708)],
)
def test_angles(spark, a, b, theta, alpha):
    r = field.pairs(places(spark, [a], "p"), places(spark, [b], "s"), ["p"], ["s"]).first()
    assert r.theta == pytest.approx(theta, abs=1e-4) and r.alpha == pytest.approx(alpha, abs=1e-4)


def test_pairs_are_dealt_to_a_bounded_number_of_tasks(spark, monkeypatch):
    """The pairs grow with the square of the input, the tasks that make them don't."""
    monkeypatch.setattr(field, "PAIRS_AT_ONCE", 1)
    monkeypatch.setattr(field, "MOST_TASKS", 7)
    points, poles = places(spark, [(50 + k / 10, 20) for k in range(12)], "p"), places(spark, [(10, 30), (11, 31), (12, 32)], "s")
    found = field.pairs(points, poles, ["p"], ["s"])
    assert found.rdd.getNumPartitions() == 7
    assert sorted((r.p, r.s) for r in found.collect()) == [(p, s) for p in range(12) for s in range(3)]


def test_pairs_by_place_are_the_same_pairs_in_fewer_bytes(spark, monkeypatch, tmp_path):
    """On a grid of tenths of a degree the pairs of neighbours take less than half the bytes; a point without a place keeps its pairs."""
    points = places(spark, [(50 + k % 2 / 10, -100 + k * 91 % 401 / 10) for k in range(802)], "p")
    points = points.union(spark.range(802, 803).selectExpr("id", "CAST(NULL AS DOUBLE)", "10.0D"))
    poles = places(spark, [(47.013 + k % 3 / 10, -100.017 + k * 71 % 397 / 10) for k in range(300)], "s")
    size = {}
    monkeypatch.setattr(field, "PAIRS_BY_PLACE", 0)
    monkeypatch.setattr(field, "PAIRS_AT_ONCE", 100_000)
    for by_place in (False, True):
        found = field.transfer_rows(points, 0.0, poles, 110e3, ["p"], ["s"], by_place=by_place)
        found = found.withColumns({c: F.rint(F.col(c) * 1e21) / 1e6 for c in ("t_i", "t_j", "t_k")})
        found.write.parquet(f"{tmp_path}/{by_place}")
        size[by_place] = sum(f.stat().st_size for f in (tmp_path / str(by_place)).glob("*.parquet"))
    a, b = (spark.read.parquet(f"{tmp_path}/{x}") for x in (False, True))
    assert b.count() == 803 * 300 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert size[True] < size[False] / 2, size


@pytest.mark.parametrize("most", [1, 7])
def test_pairs_by_place_in_many_units_and_of_nothing(spark, monkeypatch, most):
    monkeypatch.setattr(field, "PAIRS_BY_PLACE", -1)
    monkeypatch.setattr(field, "PAIRS_AT_ONCE", 1)
    monkeypatch.setattr(field, "MOST_TASKS", most)
    points, poles = places(spark, [(50, 20)] * 5 + [(50 + k / 10, 20) for k in range(7)], "p"), places(spark, [(10, 30), (11, 31), (11, 31)], "s")
    found = field.pairs(points, poles, ["p"], ["s"], by_place=True)
    assert sorted((r.p, r.s) for r in found.collect()) == [(p, s) for p in range(12) for s in range(3)]
    for a, b in ((points, poles.limit(0)), (points.limit(0), poles)):
        assert field.pairs(a, b, ["p"], ["s"], by_place=True).isEmpty()


def test_transfer_values(spark):
    points, poles = places(spark, [(50, 20), (51, 21)], "p"), places(spark, [(10, 30), (11, 31), (12, 32)], "s")
    r = 6371e3
    under = field.transfer_rows(points, 3000 - r, poles, 4000 - r, ["p"], ["s"]).where("p = 0").orderBy("s").collect()
    assert [x.t_i for x in under] == pytest.approx([-3.67250861e-11, -3.67476077e-11, -3.67074095e-11], rel=1e-8)
    assert [x.t_j for x in under] == pytest.approx([9.94787927e-12, 1.11826106e-11, 1.24566687e-11], rel=1e-8)
    assert [x.t_k for x in under] == pytest.approx([-1.76265553e-11, -1.84618364e-11, -1.92994257e-11], rel=1e-8)
    over = field.transfer_rows(points, 4000 - r, poles, 3000 - r, ["p"], ["s"]).where("p = 0").orderBy("s").collect()
    assert [x.t_i for x in over] == pytest.approx([1.248881305890098e-11, 1.257667569294579e-11, 1.264169224772104e-11], rel=1e-12)


def test_coincident_places_give_zero_or_nan(spark):
    at = [(50, 40), (45, 45), (45.14, 10)]
    r = {(x.p, x.s): x for x in field.transfer_rows(places(spark, at, "p"), 0.0, places(spark, at, "s"), 110e3, ["p"], ["s"]).collect()}
    for k in range(3):
        t = [r[k, k].t_i, r[k, k].t_j, r[k, k].t_k]
        assert t == [0, 0, 0] or all(map(math.isnan, t)) or all(abs(x) < 1e-6 for x in t)


def test_single_pole(spark):
    pole = places(spark, [(10, 20)], "pole_idx")
    two = observations(spark, [(40, 50, 1, 3, 5), (50, 60, 2, 4, 6)])
    for fitted in (field.fit_single_pole(two, pole, pole_altitude=0.0), field.fit(two, pole, pole_altitude=0.0, cutoff=0.05)):
        assert fitted.first().amp == pytest.approx(-1.803280385158305e14, rel=1e-9)
    four = observations(spark, [(40, 50, 1, 3, 5), (50, 60, 2, 4, 6), (60, 70, 6, 8, 10), (70, 80, 7, 9, 11)])
    amplitudes = field.fit_single_pole(four, pole, pole_altitude=0.0)
    points = places(spark, [(40, 50), (50, 60), (60, 70), (70, 80)], "point_idx")
    got = field.predict(points, pole, amplitudes, altitude=110e3, pole_altitude=0.0).orderBy("point_idx").collect()
    assert [(x.i, x.j, x.k) for x in got] == [
        pytest.approx(v, rel=1e-9)
        for v in (
            (-2.9721985560476623, -3.524936055971201, 2.1625944014276293),
            (-1.9295344150381564, -2.619481700089664, 0.7058854169668979),
            (-1.3007860482981708, -2.126884161397398, -0.1073352052343382),
            (-0.8729398495707357, -1.8459492569556268, -0.5871575186673494),
        )
    ]


def test_four_poles(spark):
    poles = places(spark, [(50, 40), (50, 50), (60, 40), (60, 50)], "pole_idx")
    obs = observations(spark, [(40, 50, 100, 300, 5), (50, 60, 200, 400, 6), (60, 70, 600, 800, 10), (70, 80, 700, 900, 11)])
    points = places(spark, [(40, 50), (50, 60), (60, 70), (70, 80)], "point_idx")
    got = field.predict(points, poles, field.fit(obs, poles, pole_altitude=0.0, cutoff=0.05), altitude=110e3, pole_altitude=0.0).orderBy("point_idx").collect()
    assert [(x.i, x.j, x.k) for x in got] == [
        pytest.approx(v, rel=1e-7)
        for v in (
            (257.823724031822, -257.9989840916952, 293.0630608681675),
            (104.39995806060591, -203.84660351258992, 168.9489278540623),
            (10.54058323539585, -241.81166590941018, 190.60748617783958),
            (-44.89013986250664, -183.73983360583236, 135.6276277064731),
        )
    ]


def test_fit_equals_pseudo_inverse(spark):
    rng = np.random.default_rng(5)
    stations = np.column_stack([rng.uniform(40, 80, 60), rng.uniform(-170, 30, 60), rng.normal(0, 100, (60, 3))])
    pole_rows = [(a, b) for a in (45.5, 55.5, 65.5, 75.5) for b in (-150.5, -100.5, -50.5, 0.5)]
    obs, poles = observations(spark, stations.tolist()), places(spark, pole_rows, "pole_idx")
    got = [x.amp for x in field.fit(obs, poles, slice_rows=7).orderBy("pole_idx").collect()]
    t = field.transfer_matrix(stations[:, 0], stations[:, 1], 0.0, pd.DataFrame(pole_rows, columns=["lat", "lon"]), 110e3)
    inverse = field.pseudo_inverse(t, 0.1)
    assert got == pytest.approx(inverse @ stations[:, 2:].reshape(-1), rel=1e-6)
    twice = [x.amp for x in field.fit(obs.withColumns({c: F.col(c) * 2 for c in "ijk"}), poles).orderBy("pole_idx").collect()]
    assert twice == pytest.approx([2 * a for a in got], rel=1e-6)


def test_fit_by_either_side_and_by_iteration(spark):
    rng = np.random.default_rng(7)
    for n, m in ((5, 40), (90, 40), (30, 60)):
        stations = np.column_stack([rng.uniform(40, 80, n), rng.uniform(-170, 30, n), rng.normal(0, 100, (n, 3))])
        pole_rows = list(zip(rng.uniform(45, 85, m), rng.uniform(-170, 35, m), strict=True))
        obs = observations(spark, [*stations.tolist(), *stations[:2].tolist()])
        t = field.transfer_matrix(stations[:, 0], stations[:, 1], 0.0, pd.DataFrame(pole_rows, columns=["lat", "lon"]), 110e3)
        t, b = np.concatenate([t, t[:6]]), np.concatenate([stations[:, 2:].reshape(-1), stations[:2, 2:].reshape(-1)])
        want = field.pseudo_inverse(t, 0.1) @ b
        for options in ({}, {"slice_rows": 11}, {"most_gram": 10, "width": 4, "slice_rows": 40})[: 3 if n == 90 else 1]:
            got = [x.amp for x in field.fit(obs, places(spark, pole_rows, "pole_idx"), **options).orderBy("pole_idx").collect()]
            assert got == pytest.approx(want, rel=1e-6, abs=1e-6 * np.abs(want).max())


def test_frames_share_a_factorisation(spark):
    rng = np.random.default_rng(8)
    at = [(float(a), float(b)) for a, b in zip(rng.uniform(40, 80, 9), rng.uniform(-170, 30, 9), strict=True)]
    rows = [(frame, k, *at[k], *map(float, rng.normal(0, 100, 3))) for frame in range(6) for k in range(9 if frame < 4 else 7)]
    obs = spark.createDataFrame(rows, "frame_id long, obs_idx long, lat double, lon double, i double, j double, k double")
    pole_rows = [(50.5, -100.5), (60.5, -50.5), (70.5, 0.5), (55.5, -20.5)]
    got = {(r.frame_id, r.pole_idx): r.amp for r in field.fit(obs, places(spark, pole_rows, "pole_idx")).collect()}
    for frame in range(6):
        own = np.array([r[2:] for r in rows if r[0] == frame])
        t = field.transfer_matrix(own[:, 0], own[:, 1], 0.0, pd.DataFrame(pole_rows, columns=["lat", "lon"]), 110e3)
        assert [got[frame, k] for k in range(4)] == pytest.approx(field.pseudo_inverse(t, 0.1) @ own[:, 2:].reshape(-1), rel=1e-6)


def test_production_size(spark):
    """65 stations, 2,500 poles, 4,810 points."""
    rng = np.random.default_rng(65)
    stations = np.column_stack([rng.uniform(28, 83, 65), rng.uniform(-150, 352, 65), rng.normal(0, 80, (65, 2)), np.zeros(65)])
    poles = grid.geographical_grid(spark, *POLE_GRID).withColumnRenamed("idx", "pole_idx")
    points = grid.geographical_grid(spark, *POINT_GRID).withColumnRenamed("idx", "point_idx")
    amplitudes = field.fit(observations(spark, stations.tolist()), poles).toPandas().sort_values("pole_idx")["amp"].to_numpy()
    at = poles.orderBy("pole_idx").toPandas()
    want = field.pseudo_inverse(field.transfer_matrix(stations[:, 0], stations[:, 1], 0.0, at, 110e3), 0.1) @ stations[:, 2:].reshape(-1)
    assert amplitudes == pytest.approx(want, rel=1e-6, abs=1e-9 * np.abs(want).max())
    got = field.predict(points, poles, field.fit(observations(spark, stations.tolist()), poles)).orderBy("point_idx").toPandas()
    t = field.transfer_matrix(got["lat"].to_numpy()[::37], got["lon"].to_numpy()[::37], 110e3, at, 110e3)
    assert len(got) == 4810 and got[["i", "j", "k"]].to_numpy()[::37].reshape(-1) == pytest.approx(t @ want, rel=1e-5, abs=1e-5)


def _inverse_of(spark, t, cutoff, **options):
    rows = spark.createDataFrame([("x", n, [float(v) for v in r]) for n, r in enumerate(t)], "set_id string, row long, cells array<double>")
    return np.array([r.weights for r in factors.inverse_rows(rows, cutoff, **options).orderBy("row").collect()]).T


@pytest.mark.parametrize("columns", [1, 4])
def test_inverse_of_rows_by_a_tree_of_triangles(spark, columns):
    """A hundred rows in slices of two to five: seven levels of values down to 1e-9 of the largest, kept and cut."""
    rng = np.random.default_rng(columns)
    u, _, v = np.linalg.svd(rng.normal(size=(100, columns)), full_matrices=False)
    d = 10.0 ** -np.arange(0, 3 * columns, 3)
    t = u * d @ v
    for cutoff in (1e-10, 1e-4):
        keep = d >= cutoff
        got, want = _inverse_of(spark, t, cutoff, slice_rows=3), v[keep].T / d[keep] @ u[:, keep].T
        assert np.linalg.norm(got - want) <= 1e-5 * np.linalg.norm(want)
    assert factors.inverse_rows(spark.createDataFrame([], "set_id string, row long, cells array<double>"), 0.1).collect() == []


def test_fit_with_a_small_cutoff(spark):
    """Both sides' small case, and slices joined in a tree, against the singular values of the whole matrix."""
    rng = np.random.default_rng(31)
    for n, m in ((4, 30), (60, 8)):
        stations = np.column_stack([rng.uniform(40, 80, n), rng.uniform(-170, 30, n), rng.normal(0, 100, (n, 3))])
        pole_rows = list(zip(rng.uniform(45, 85, m), rng.uniform(-170, 35, m), strict=True))
        t = field.transfer_matrix(stations[:, 0], stations[:, 1], 0.0, pd.DataFrame(pole_rows, columns=["lat", "lon"]), 110e3)
        want = field.pseudo_inverse(t, 1e-10) @ stations[:, 2:].reshape(-1)
        got = [x.amp for x in field.fit(observations(spark, stations.tolist()), places(spark, pole_rows, "pole_idx"), cutoff=1e-10, slice_rows=5).orderBy("pole_idx").collect()]
        assert got == pytest.approx(want, rel=1e-5, abs=1e-5 * np.abs(want).max())


def test_prediction_through_the_basis(spark, monkeypatch):
    rng = np.random.default_rng(33)
    at = [(float(a), float(b)) for a, b in zip(rng.uniform(40, 80, 12), rng.uniform(-170, 30, 12), strict=True)]
    rows = [(f, k, *at[k], *map(float, rng.normal(0, 100, 3))) for f in range(12) for k in range(12 if f % 3 else 8)]
    obs = spark.createDataFrame(rows, "frame_id long, obs_idx long, lat double, lon double, i double, j double, k double")
    poles = places(spark, list(zip(rng.uniform(45, 85, 40), rng.uniform(-170, 35, 40), strict=True)), "pole_idx")
    points = places(spark, list(zip(rng.uniform(45, 85, 50), rng.uniform(-180, 179, 50), strict=True)), "point_idx")
    for small in (False, True):
        if small:
            for module, name, value in ((field, "FRAMES_AT_ONCE", 3), (field, "SETS_AT_ONCE", 1), (field, "CELLS", 500), (field, "ROWS_AT_ONCE", 40)):
                monkeypatch.setattr(module, name, value)
        fitted = field.fitted(obs, poles)
        amplitudes = fitted.amplitudes()
        got = fitted.predict(points).toPandas().sort_values(["frame_id", "point_idx"])[["lat", "lon", "i", "j", "k"]].to_numpy()
        want = field.predict(points, poles, amplitudes).toPandas().sort_values(["frame_id", "point_idx"])[["lat", "lon", "i", "j", "k"]].to_numpy()
        alone = field.predict(points, poles, amplitudes.where("frame_id = 7")).toPandas().sort_values("point_idx")[["i", "j", "k"]].to_numpy()
        assert len(got) == 600 and fitted.factors.count() == 2
        assert got == pytest.approx(want, rel=1e-9, abs=1e-9 * np.abs(want[:, 2:]).max())
        assert want[350:400, 2:] == pytest.approx(alone, rel=1e-9, abs=1e-9 * np.abs(alone).max())
    assert field.fitted(obs, poles).predict(points.limit(0)).collect() == []


def test_factors_are_kept_by_what_they_follow_from(spark, tmp_path):
    rng = np.random.default_rng(35)
    stations = np.column_stack([rng.uniform(40, 80, 6), rng.uniform(-170, 30, 6), rng.normal(0, 100, (6, 3))]).tolist()
    obs, poles, store = observations(spark, stations), places(spark, [(50, 40), (60, -50), (70, 10)], "pole_idx"), Store(spark, f"{tmp_path}/store")
    first = field.fitted(obs, poles, store=store)
    again = field.fitted(observations(spark, stations[::-1]).withColumn("i", F.col("i") * 2), poles, store=store)
    assert (first.made, again.made, len(store.versions("factors"))) == (1, 0, 1)
    fresh = [r.amp for r in field.fit(observations(spark, stations).withColumn("i", F.col("i") * 2), poles).orderBy("pole_idx").collect()]
    assert [r.amp for r in again.amplitudes().orderBy("pole_idx").collect()] == pytest.approx(fresh)
    others = ({"altitude": 10.0}, {"pole_altitude": 100e3}, {"cutoff": 0.2})
    assert [field.fitted(obs, poles, store=store, **o).made for o in others] == [1, 1, 1]
    assert field.fitted(obs, poles.where("pole_idx < 2"), store=store).made == 1
    assert field.fitted(obs.where("obs_idx > 0"), poles, store=store).made == 1
    assert field.fitted(obs.union(obs.limit(1)), poles, store=store).made == 1
    assert field.fitted(obs.limit(0), poles, store=store).made == 0 and store.parts("factors").count() == 7


def test_iteration_over_many_slices(spark):
    """Subspace iteration with slices and blocks of rows joined in trees, and more columns than it began with."""
    rng = np.random.default_rng(37)
    n, m = 70, 50
    stations = np.column_stack([rng.uniform(40, 80, n), rng.uniform(-170, 30, n), rng.normal(0, 100, (n, 3))])
    pole_rows = list(zip(rng.uniform(45, 85, m), rng.uniform(-170, 35, m), strict=True))
    grid_ = pd.DataFrame([(k, *p) for k, p in enumerate(pole_rows)], columns=["pole_idx", "lat", "lon"])
    rows = [("s", n, k % 11, float(a), float(b), 1) for k, (a, b) in enumerate(stations[:, :2])]
    sliced = spark.createDataFrame(rows, "set_id string, stations long, slice int, lat double, lon double, n long")
    make = factors.Stations(grid_, 0.0, 110e3, 1e15)
    (row,) = factors.factored(sliced, make, 0.1, slice_rows=8, slices=11, tasks=4, most_gram=10, width=3, block=30).collect()
    basis = factors.matrix(row.basis, len(row.basis) // 8 // m)
    t = field.transfer_matrix(stations[:, 0], stations[:, 1], 0.0, grid_, 110e3)
    want = field.pseudo_inverse(t, 0.1) * 1e15**-1
    assert basis @ basis.T @ (t * 1e15).T == pytest.approx(want, rel=1e-6, abs=1e-6 * np.abs(want).max())


def test_leading_eigenpairs_equal_all():
    rng = np.random.default_rng(45)
    u = np.linalg.qr(rng.normal(size=(600, 600)))[0]
    for d in (2.0 ** -np.arange(600.0), 1.0 / (1 + np.arange(600.0)), np.ones(600)):
        gram = u * np.maximum(d, 1e-18) @ u.T
        values, vectors = factors.kept_space(gram, 0.1)
        n = int((d >= 0.01 * (1 - 1e-9)).sum())
        assert values[::-1][: n - 1] == pytest.approx(d[: n - 1]) and len(values) in (n - 1, n)
        space = vectors @ vectors.T
        assert space == pytest.approx(u[:, : len(values)] @ u[:, : len(values)].T, abs=1e-6)


@pytest.mark.parametrize("columns", [12, 10_000])
def test_krylov_space_in_few_passes(monkeypatch, columns):
    """Values that fall slowly: subspace iteration with as many columns takes a hundred passes or more; with and without restarts."""
    monkeypatch.setattr(factors, "KRYLOV_COLUMNS", columns)
    rng, passes = np.random.default_rng(12), []
    q = np.linalg.qr(rng.normal(size=(300, 300)))[0]
    values = 0.97 ** np.arange(300)
    gram = q * values @ q.T
    got, vectors = factors.krylov_space(lambda x: passes.append(x.shape[1]) or gram @ x, 300, 0.5, 20)
    kept = values >= 0.25
    assert np.sort(got)[::-1] == pytest.approx(values[kept], rel=1e-9)
    assert np.abs(vectors @ vectors.T - q[:, kept] @ q[:, kept].T).max() < 1e-8
    assert columns == 12 or len(passes) < 40


def test_fit_of_one_slice_in_passes(spark):
    rng = np.random.default_rng(13)
    stations = np.column_stack([rng.uniform(40, 80, 70), rng.uniform(-170, 30, 70), rng.normal(0, 100, (70, 3))])
    pole_rows = list(zip(rng.uniform(45, 85, 50), rng.uniform(-170, 35, 50), strict=True))
    t = field.transfer_matrix(stations[:, 0], stations[:, 1], 0.0, pd.DataFrame(pole_rows, columns=["lat", "lon"]), 110e3)
    want = field.pseudo_inverse(t, 0.1) @ stations[:, 2:].reshape(-1)
    fitted = field.fitted(observations(spark, stations.tolist()), places(spark, pole_rows, "pole_idx"), most_gram=10, width=4)
    assert [x.amp for x in fitted.amplitudes().orderBy("pole_idx").collect()] == pytest.approx(want, rel=1e-6, abs=1e-6 * np.abs(want).max())


def test_sets_of_several_slices_go_in_passes(spark, monkeypatch):
    """Subspace iteration would read a set's stations some dozens of times by all executors; up to PASS_SLICES slices one task makes fewer passes."""

    def never(*_):
        raise AssertionError("subspace iteration")

    monkeypatch.setattr(factors._Iteration, "run", never)
    rng = np.random.default_rng(15)
    stations = np.column_stack([rng.uniform(40, 80, 70), rng.uniform(-170, 30, 70), rng.normal(0, 100, (70, 3))])
    pole_rows = list(zip(rng.uniform(45, 85, 50), rng.uniform(-170, 35, 50), strict=True))
    t = field.transfer_matrix(stations[:, 0], stations[:, 1], 0.0, pd.DataFrame(pole_rows, columns=["lat", "lon"]), 110e3)
    want = field.pseudo_inverse(t, 0.1) @ stations[:, 2:].reshape(-1)
    fitted = field.fitted(observations(spark, stations.tolist()), places(spark, pole_rows, "pole_idx"), most_gram=10, width=4, slice_rows=20)
    assert [x.amp for x in fitted.amplitudes().orderBy("pole_idx").collect()] == pytest.approx(want, rel=1e-6, abs=1e-6 * np.abs(want).max())


def test_passes_give_the_matrix_of_batches():
    """Piece by piece in the same memory; where a station has a pole's place the general form decides, which raises here."""
    rng = np.random.default_rng(16)
    poles = pd.DataFrame({"lat": rng.uniform(45, 85, 3_000), "lon": rng.uniform(-170, 35, 3_000)})
    stations = pd.DataFrame({"lat": rng.uniform(45, 85, 50), "lon": rng.uniform(-170, 35, 50)})
    make = factors.Stations(poles, 0.0, 110e3, 1e15, cells=27_000)
    want = np.concatenate([t for _, t in make.batches(stations)])
    found = [(some, t.copy()) for some, t in make.passes(stations, cells=100_000)]
    assert len(found) > 1 and [k for some, _ in found for k in range(*some.indices(50))] == list(range(50))
    assert np.abs(np.concatenate([t for _, t in found]) - want).max() < 1e-9 * np.abs(want).max()
    stations.loc[11, ["lat", "lon"]] = [50.0, 40.0]
    poles.loc[2, ["lat", "lon"]] = [50.0, 40.0]
    one = factors.transfer_matrix(np.array([50.0]), np.array([40.0]), 0.0, poles[2:3], 110e3)
    if np.isfinite(one).all():
        at = next(t[3 * (11 - some.start) : 3 * (12 - some.start), 2].copy() for some, t in make.passes(stations, cells=100_000) if some.start <= 11 < some.stop)
        assert at == pytest.approx(one[:, 0] * 1e15)
    else:
        with pytest.raises(factors.FitError):
            list(make.passes(stations, cells=100_000))


def test_few_poles_share_the_kernel(spark, monkeypatch):
    """At two poles nothing is stored for each set: the plan has no table of projected kernels."""
    rng = np.random.default_rng(14)
    rows = [(f, k, float(40 + 2 * k), float(10 * k), *map(float, rng.normal(0, 100, 3))) for f in range(5) for k in range(4 + f)]
    obs = spark.createDataFrame(rows, "frame_id long, obs_idx long, lat double, lon double, i double, j double, k double")
    poles, points = places(spark, [(61.0, -95.0), (65.0, -70.0)], "pole_idx"), places(spark, [(50 + k, 3 * k) for k in range(20)], "point_idx")
    fitted, asked = field.fitted(obs, poles), []
    monkeypatch.setattr(field, "saved", lambda df, path: asked.append(path) or df)
    got = fitted.predict(points).toPandas().sort_values(["frame_id", "point_idx"])[["i", "j", "k"]].to_numpy()
    assert not asked and len(got) == 100
    monkeypatch.setattr(field, "FEW_POLES", 0)
    want = fitted.predict(points).toPandas().sort_values(["frame_id", "point_idx"])[["i", "j", "k"]].to_numpy()
    assert asked and got == pytest.approx(want, rel=1e-9, abs=1e-9 * np.abs(want).max())


def test_pseudo_inverse_properties():
    """The identities of a truncated pseudo-inverse, on one column and on four."""
    rng = np.random.default_rng(12)
    for m in (1, 4):
        t = rng.normal(size=(12, m)) @ np.diag([1.0, 0.5, 0.2, 0.01][:m])
        x = field.pseudo_inverse(t, 0.05)
        cut = t @ x @ t  # t without its small singular values
        assert x @ cut @ x == pytest.approx(x) and (t @ x) == pytest.approx((t @ x).T) and (x @ cut) == pytest.approx((x @ cut).T)
        assert np.linalg.matrix_rank(cut, tol=1e-9) == min(m, 3)
    column = np.arange(1.0, 13.0)[:, None]
    assert field.pseudo_inverse(column, 0.05) == pytest.approx(column.T / (column**2).sum())


def test_poles_without_amplitude_are_a_typed_error(spark):
    poles, points = places(spark, [(50, 40), (60, 50)], "pole_idx"), places(spark, [(55, 45)], "point_idx")
    for rows in ([(1, 0, 1.0)], [(1, 0, 1.0), (1, 1, 2.0), (1, 2, 3.0)], [(1, 0, 1.0), (1, 0, 2.0)]):
        with pytest.raises(field.PoleError):
            field.predict(points, poles, spark.createDataFrame(rows, "frame_id long, pole_idx long, amp double"))
    two = spark.createDataFrame([(f, p, float(f + p)) for f in (1, 2) for p in (0, 1)], "frame_id long, pole_idx long, amp double")
    both = {r.frame_id: r.i for r in field.predict(points, poles, two).collect()}
    alone = {f: field.predict(points, poles, two.where(f"frame_id = {f}")).first().i for f in (1, 2)}
    assert both == pytest.approx(alone)
    with pytest.raises(field.FitError):
        field.fit_two_poles(observations(spark, [(40, 50, 1, 3, 5)]), poles, poles.where("pole_idx = 0"))


def test_nan_is_a_typed_error(spark):
    obs = observations(spark, [(40, 50, float("nan"), 3, 5)])
    with pytest.raises(Exception, match="NaN"):
        field.fit(obs, places(spark, [(10, 20)], "pole_idx")).collect()
    with pytest.raises(field.FitError):
        field.fit(obs, places(spark, [], "pole_idx"))


def of(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("i, score", [(0, 0), (1, 0), (50, 1.3853), (100, 2.4717), (200, 4.2133), (-800, 9.987), (1000, 10)])
def test_field_score(spark, i, score):
    assert of(spark, scores.field_score(F.lit(float(i)))) == pytest.approx(score, abs=1e-3)


@pytest.mark.parametrize("d, score", [(0, 0), (9.999, 0), (10, 1), (-150, 15)])
def test_derivative_score(spark, d, score):
    assert of(spark, scores.derivative_score(F.lit(float(d)))) == score


@pytest.mark.parametrize("d, w", [(0, 0), (2200, 1.0), (2200.001, 1.0001), (2700, 1.0002), (2700.001, 1.0006), (3300, 0.5008), (4000, 0.1046), (5000, 0.0015), (5000.001, 0.3)])
def test_zone_weight(spark, d, w):
    assert of(spark, scores.zone_weight(F.lit(float(d)))) == pytest.approx(w, abs=1e-4)


@pytest.mark.parametrize("score, flag, code", [(0, 0, 0), (10, 0, 40000), (12.5, 3, 40003), (3.1416, 1, 12569), (-1, 2, 2), (1.0005, 0, 4004), (float("nan"), 1, 1)])
def test_encode(spark, score, flag, code):
    assert of(spark, scores.encode(F.lit(float(score)), flag)) == code


def test_larger_ignores_nan(spark):
    nan = F.lit(float("nan"))
    assert of(spark, scores.larger(nan, F.lit(2.0))) == 2 and of(spark, scores.larger(F.lit(2.0), nan)) == 2
    assert math.isnan(of(spark, scores.larger(nan, nan)))


@pytest.mark.parametrize("at, to", [((0, 50), (50, 0)), ((-72.8, 60.8), (80.615799, 27.777665)), ((100, -30), (253.260422, -58.525051))])
def test_rotate_and_back(spark, at, to):
    a, b = rotations.rotate(F.lit(float(at[0])), F.lit(float(at[1])))
    c, d = rotations.unrotate(a, b)
    r = spark.range(1).select(a, b, c, d).first()
    assert tuple(r[:2]) == pytest.approx(to, abs=1e-5)
    assert (r[2] - at[0] + 1e-7) % 360 == pytest.approx(0, abs=1e-6) and r[3] == pytest.approx(at[1])


@pytest.mark.parametrize("at, to", [((-72.8, -80.8), (107.2, -80.8)), ((0, -50), (22.914023, -51.894795)), ((100, -65), (102.771442, -46.687788))])
def test_to_south_pole(spark, at, to):
    assert tuple(spark.range(1).select(*rotations.to_south_pole(F.lit(float(at[0])), F.lit(float(at[1])))).first()) == pytest.approx(to, abs=1e-5)


def _circle(n, radius, x=0.0, y=0.0, left=True):
    a = np.linspace(0, 2 * np.pi, n + 1) * (1 if left else -1)
    return np.column_stack([x + radius * np.cos(a), y + radius * np.sin(a)])[[*range(n), 0]]


def test_holes_go_to_the_smallest_ring_around_them():
    disc, hole, island, pond, other = _circle(40, 9), _circle(30, 7, left=False), _circle(20, 5), _circle(10, 2, left=False), _circle(12, 1, 30)
    found = contours.nested([pond, other, hole, island, disc])
    assert sorted((len(p), round(sum(map(contours.signed_area, p)))) for p in found) == sorted((n, round(contours.signed_area(a) + b)) for n, a, b in [(1, other, 0), (2, island, contours.signed_area(pond)), (2, disc, contours.signed_area(hole))])
    assert contours.nested([]) == [] and contours.nested([np.array([[1.0, 1.0], [2.0, 2.0], [1.0, 1.0]])]) == []
    square = np.array([[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], float)
    touching = np.array([[0, 0], [1, 2], [2, 1], [0, 0]], float)  # a hole that shares a corner with its outer ring
    assert [len(p) for p in contours.nested([touching, square])] == [2]


def test_nested_rings_of_random_grids(spark):
    """Areas and the numbers of rings agree with the segments and with counts over squares of cells."""
    rng = np.random.default_rng(21)
    for turn in range(3):
        cells = [(x, y, float(v)) for x in range(14) for y in range(11) for v in [rng.random()] if v > 0.1]
        grid_ = spark.createDataFrame(cells, "x long, y long, density double")
        lines = contours.segments(grid_, [0.5]).toPandas()
        rows = contours.ring_areas(contours.polygons(grid_, [0.5])).collect()
        assert sum(r.area for r in rows) == pytest.approx((lines.x1 * lines.y2 - lines.x2 * lines.y1).sum() / 2)
        assert sum(r.vertices for r in rows) == len(lines)
        above = np.zeros((16, 13), bool)
        for x, y, v in cells:
            above[x + 1, y + 1] = v >= 0.5
        a, b, c, d = above[:-1, :-1], above[1:, :-1], above[:-1, 1:], above[1:, 1:]
        n = a.astype(int) + b + c + d
        euler = ((n == 1).sum() - (n == 3).sum() + 2 * ((n == 2) & (a == d)).sum()) // 4
        assert sum(not r.hole for r in rows) - sum(r.hole for r in rows) == euler
        assert all((r.area < 0) == r.hole and r.outer_area >= abs(r.area) for r in rows)
        # a place is above the threshold just where the outermost polygon around it doesn't have it in a hole
        polygons = [[np.array(ring) for ring in r.rings] for r in contours.polygons(grid_, [0.5]).collect()]
        centres = np.array([(x + 0.5, y + 0.5) for x, y, _ in cells])
        covered = sum((contours.within(centres, p[0]) & ~np.any([contours.within(centres, h) for h in p[1:]], axis=0) if p[1:] else contours.within(centres, p[0])).astype(int) for p in polygons)
        assert covered.tolist() == [int(v >= 0.5) for _, _, v in cells]


def test_an_annulus_is_one_polygon_of_two_rings(spark):
    ring = [(20.0 * math.cos(a), 55.0 + 20.0 * math.sin(a), 5.0) for a in np.linspace(0, 2 * math.pi, 120, endpoint=False)]
    for rows, shape in ((ring, [2]), ([*ring, (0.0, 55.0, 40.0)], [1, 2])):
        scored = spark.createDataFrame(rows, "lon double, lat double, score double")
        (found,) = contours.contours(scored, shares=[0.01], mirror=False, bandwidth=1.0).collect()
        assert sorted(map(len, found.coordinates)) == shape
        assert all(r[0] == r[-1] for p in found.coordinates for r in p)


def test_contours_are_closed_rings(spark):
    scored = spark.createDataFrame([(10.0, 65.0, 5.0), (12.0, 66.0, 7.0), (40.0, 70.0, 2.0)], "lon double, lat double, score double")
    top = contours.density(scored).agg(F.max("density")).first()[0]
    found = contours.contours(scored, [0.0, top / 2, top * 2], mirror=False).collect()
    assert [r.value for r in found] == [top / 2]
    for (ring,) in found[0].coordinates:
        assert ring[0] == ring[-1] and len(ring) > 4
    assert contours.contours(scored.where("score > 100"), [1.0]).count() == 0


def test_contour_thresholds_and_cells(spark):
    scored = spark.createDataFrame([(10.0, 65.0, 5.0), (12.0, 66.0, 7.0), (40.0, 70.0, 2.0)], "lon double, lat double, score double")
    top = contours.density(scored).agg(F.max("density")).first()[0]
    values = of(spark, contours.even_thresholds(F.lit(float(top)), 10))
    assert 5 <= len(values) <= 20 and 0 < values[0] and values[-1] <= top and values == pytest.approx([values[0] * k for k in range(1, len(values) + 1)])
    assert of(spark, contours.even_thresholds(F.lit(0.93), 9)) == pytest.approx([0.1 * k for k in range(1, 10)])
    assert of(spark, contours.even_thresholds(F.lit(0.0), 9)) == []
    assert sorted(r.value for r in contours.contours(scored, 10, mirror=False).collect()) == pytest.approx([v for v in values if v < top])
    shares = contours.contours(scored, shares=[0.5, 2.0], mirror=False).collect()
    assert [r.value for r in shares] == pytest.approx([top / 2])
    # twice the cell, nearly the same polygon
    (ring,), (wide,) = shares[0].coordinates, contours.contours(scored, [top / 2], mirror=False, cell=2).first().coordinates
    centre = lambda r: np.mean(r[0], axis=0)
    assert centre(wide) == pytest.approx(centre(ring), abs=2)
    with pytest.raises(ValueError):
        contours.density(scored, cell=7)


def test_merge_keeps_common_points(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 3.0), (2, 0.0, 0.0, 4.0)], "n long, lat double, lon double, score double")
    b = spark.createDataFrame([(1, 9.0, 9.0, 5.0)], "n long, lat double, lon double, score double")
    assert [tuple(r) for r in scoring.merged(a, b, ["n"]).collect()] == [(1, 0.0, 0.0, 5.0)]


def test_engine_order_and_state(spark, tmp_path):
    poles, points = places(spark, [(50, 40), (60, 50)], "pole_idx"), places(spark, [(55, 45), (65, 40)], "point_idx")
    engine = Engine(spark, f"{tmp_path}/engine", poles, points)
    obs = observations(spark, [(40, 50, 100, 300, 5), (50, 60, 200, 400, 6)])
    for call in (engine.fit_pred, engine.predict, lambda: engine.fit_obs(obs.limit(0))):
        with pytest.raises(NotFitted):
            call()
    assert engine.scores().collect() == [] and engine.scores().columns == ["frame_id", "point_idx", "code"]
    assert engine.fit_obs(obs)
    engine.fit_pred()
    assert not engine.fit_obs(obs)
    assert engine.predict().count() == 2
    before = {r.point_idx: r.code for r in engine.scores().collect()}
    assert list(before) == sorted(before)
    engine.predict(derivative=True)
    after = {r.point_idx: r.code for r in engine.scores().collect()}
    assert all(after[k] >= before[k] and 0 <= after[k] <= 40003 for k in before)
    engine.state.clear()
    assert engine.state.load("points") is None


def test_store_replaces_one_name(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.store("a", spark.range(2))
    store.store("b", spark.range(3))
    store.store("a", spark.range(5))
    assert store.load("a").count() == 5 and store.load("b").count() == 3
    held = store.load("b")
    store.store("b", held.where("id > 0"))
    assert held.count() == 3 and store.load("b").count() == 2
    # a version that wasn't finished doesn't count
    (tmp_path / "b" / "9").mkdir()
    assert store.load("b").count() == 2


def test_stream_scores_every_frame(spark, tmp_path):
    from telluric.streaming.stream import score_frames

    obs = observations(spark, [(40, 50, 100, 300, 5), (50, 60, 200, 400, 6)])
    obs.unionByName(obs.withColumn("frame_id", F.lit(2).cast("long"))).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(obs.schema).parquet(f"{tmp_path}/in")
    query = score_frames(stream, places(spark, [(50, 40), (60, 50)], "pole_idx"), places(spark, [(55, 45)], "point_idx"), f"{tmp_path}/out", f"{tmp_path}/check")
    query.awaitTermination(120)
    assert sorted(r.frame_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]


def _events(spark, rows):
    return spark.createDataFrame([(f, n, (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=t)).to_pydatetime(), lat, lon, *v) for n, (f, t, lat, lon, v) in enumerate(rows)], "frame_id long, obs_idx long, ts timestamp, lat double, lon double, i double, j double, k double")


def test_derivatives_by_station_and_gap(spark):
    at = (50.0, 10.0)
    rows = [(1, 0, *at, (1.0, 2.0, 3.0)), (1, 30, *at, (4.0, 0.0, None)), (2, 30, *at, (6.0, 0.0, None)), (2, 700, *at, (0.0, 0.0, 0.0)), (2, 760, *at, (9.0, 1.0, 0.0)), (1, 31, 60.0, 10.0, (5.0, 5.0, 5.0))]
    got = [(r.frame_id, r.obs_idx, r.i, r.j, r.k) for r in derivative.derivatives(_events(spark, rows), gap=600).orderBy("obs_idx").collect()]
    assert got == [(1, 1, pytest.approx(8.0), pytest.approx(-4.0), None), (2, 4, pytest.approx(9.0), pytest.approx(1.0), 0.0)]
    assert [r.obs_idx for r in derivative.derivatives(_events(spark, rows), gap=700).orderBy("obs_idx").collect()] == [1, 3, 4]
    assert derivative.derivatives(_events(spark, rows).limit(0)).collect() == []
    with pytest.raises(ValueError):
        derivative.derivatives(_events(spark, rows), gap=60, block=30)


def test_derivatives_dont_depend_on_blocks(spark):
    rng = np.random.default_rng(41)
    rows = [(1, int(t), float(40 + s), 0.0, (float(v), 0.0, 0.0)) for s, t, v in zip(rng.integers(0, 3, 300), rng.integers(0, 20_000, 300), rng.normal(size=300), strict=True)]
    want: dict[tuple, list] = {}
    for n, (_, t, lat, _, (i, _, _)) in enumerate(rows):
        want.setdefault((lat, t), []).append((n, i))
    for block in (100.0, 3_000.0, None):
        got = {r.obs_idx: r.i for r in derivative.derivatives(_events(spark, rows), gap=100, unit=1, block=block).collect()}
        own = {}
        for (lat, t), found in want.items():
            before = [u for (l, u) in want if l == lat and t - 100 <= u < t]
            if before:
                mean = lambda x: sum(i for _, i in x) / len(x)
                own[min(n for n, _ in found)] = (mean(found) - mean(want[lat, max(before)])) / (t - max(before))
        assert got == pytest.approx(own)


def test_density_in_parts_of_a_degree(spark):
    """Against the whole kernel, cell by cell; and rings of the same place and size whatever the cell."""
    scored = spark.createDataFrame([(10.0, 65.0, 5.0), (12.0, 66.0, 7.0), (40.0, 70.0, 2.0)], "lon double, lat double, score double")
    for cell in (0.25, 3.0):
        wide, high = contours.cells_of(cell)
        lon, lat = rotations.rotate(F.col("lon"), rotations.shift(F.col("lat")))
        want = np.zeros((wide, high))
        reach = math.ceil(6 / cell)
        d = np.arange(-reach, reach + 1)
        kernel = np.exp(-(d[:, None] ** 2 + d**2) * cell**2 / 8) / (8 * math.pi)
        for x, y, w in scored.select(lon, lat, F.pow("score", F.lit(1.5))).collect():
            a, b = int(x / cell), int((y + 90) / cell)
            for i in d[(a + d >= 0) & (a + d < wide)]:
                own = d[(b + d >= 0) & (b + d < high)]
                want[a + i, b + own] += w * kernel[i + reach, own + reach]
        got = np.zeros((wide, high))
        for r in contours.density(scored, cell=cell).collect():
            got[r.x, r.y] = r.density
        assert got == pytest.approx(want, rel=1e-12, abs=1e-300)
    level = [want.max() / 2]
    sizes = {c: [r.area * c * c for r in contours.ring_areas(contours.polygons(contours.density(scored, cell=c), level)).collect()] for c in (0.25, 0.5, 1)}
    assert sum(sizes[0.25]) == pytest.approx(sum(sizes[0.5]), rel=0.02) and sum(sizes[0.25]) == pytest.approx(sum(sizes[1]), rel=0.1)
    for cell in (7, 0.7, 0, -1):
        with pytest.raises(ValueError):
            contours.density(scored, cell=cell)


def test_a_frame_over_two_batches_is_fitted_once(spark, tmp_path):
    """A frame that arrives in two files, out of order, equals its fit in one piece; what comes after its frame is gone is counted."""
    from telluric.streaming.stream import LateRows, score_events

    rng = np.random.default_rng(43)
    rows = [(1, t, float(lat), float(lon), tuple(map(float, rng.normal(0, 100, 3)))) for t, lat, lon in ((5, 40, 50), (70, 50, 60), (20, 50, 60), (40, 45, 55), (65, 40, 50), (20, 50, 60), (400, 40, 50), (10, 60, 70), (900, 41, 51))]
    obs = _events(spark, rows)
    poles, points = places(spark, [(50, 40), (60, 50)], "pole_idx"), places(spark, [(55, 45)], "point_idx")
    files = [obs.where("obs_idx < 3"), obs.where("obs_idx BETWEEN 3 AND 6"), obs.where("obs_idx = 7"), obs.where("obs_idx = 8")]
    for n, part in enumerate(files):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    late = LateRows()
    spark.streams.addListener(late)
    for n in range(len(files)):
        # the same checkpoint: each start goes on with one more file
        (tmp_path / "seen").mkdir(exist_ok=True)
        stream = spark.readStream.schema(obs.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/seen")
        (tmp_path / "in" / str(n)).rename(tmp_path / "seen" / str(n))
        query = score_events(stream, poles, points, f"{tmp_path}/out", f"{tmp_path}/check", frame="1 minute", late="2 minutes", kept=f"{tmp_path}/kept")
        query.awaitTermination(180)
    got = {r.frame_id: r.score for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) == spark.read.parquet(f"{tmp_path}/out").count()
    base = pd.Timestamp("2024-01-01", tz="UTC").timestamp()
    want = {}
    for frame in (0, 1, 6):
        own = field.without_k(obs.where(f"obs_idx <> 7 AND floor((unix_seconds(ts) - {int(base)}) / 60) = {frame}")).withColumn("frame_id", F.lit(int(base) + 60 * frame).cast("long"))
        found = scoring.zone_weighted(scoring.into_scores(field.predict(points, poles, field.fit(own, poles)))).first()
        want[int(base) + 60 * frame] = found.score
    assert got == pytest.approx(want)
    for _ in range(100):  # listeners are told after the query
        if late.dropped:
            break
        time.sleep(0.1)
    spark.streams.removeListener(late)
    assert sum(late.dropped.values()) == 1


def test_engine_factors_the_same_stations_once(spark, tmp_path):
    poles, points = places(spark, [(50, 40), (60, 50)], "pole_idx"), places(spark, [(55, 45), (65, 40)], "point_idx")
    engine = Engine(spark, f"{tmp_path}/engine", poles, points)
    obs = observations(spark, [(40, 50, 100, 300, 5), (50, 60, 200, 400, 6)])
    for factor in (1.0, 2.0):
        engine.fit_obs(obs.withColumns({c: F.col(c) * factor for c in "ij"}))
    assert len(engine.state.versions("factors")) == 1
    got = [(r.i, r.j, r.k) for r in engine.predict().orderBy("point_idx").collect()]
    direct = field.predict(points, poles, field.fit(field.without_k(obs.withColumns({c: F.col(c) * 2 for c in "ij"})), poles)).orderBy("point_idx").collect()
    assert got == [pytest.approx((r.i, r.j, r.k), rel=1e-9) for r in direct]
