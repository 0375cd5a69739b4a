"""Far field by cells, regions by files, and pseudo-inverses that are given by value."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from telluric.operators import factors, farfield, field
from telluric.sources import regions
from telluric.sources.store import Store


def test_far_field_of_many_poles(spark):
    """50,000 poles: an error below 1e-6, with a fraction of the pairs."""
    rng = np.random.default_rng(51)
    m, n = 50_000, 60
    poles = pd.DataFrame({"pole_idx": np.arange(m), "lat": rng.uniform(45, 85, m), "lon": rng.uniform(-170, 35, m)})
    amp = rng.normal(0, 1e11, m)
    points = pd.DataFrame({"point_idx": np.arange(n), "lat": rng.uniform(45, 85, n), "lon": rng.uniform(-180, 540, n)})
    amplitudes = pd.DataFrame({"frame_id": 1, "pole_idx": np.arange(m), "amp": amp})
    got = farfield.predict_far(*map(spark.createDataFrame, (points, poles, amplitudes)), nodes=8).toPandas().sort_values("point_idx")
    want = np.concatenate([factors.transfer_matrix(points["lat"].to_numpy()[k : k + 10], points["lon"].to_numpy()[k : k + 10], 110e3, poles, 110e3) @ amp for k in range(0, n, 10)]).reshape(-1, 3)
    assert np.abs(got[["i", "j", "k"]].to_numpy() - want).max() <= 1e-6 * np.abs(want).max()
    level = 5
    cells = farfield.cell_of(poles["lat"].to_numpy(), poles["lon"].to_numpy(), level)
    filled = [np.unique(farfield.cell_of(poles["lat"].to_numpy(), poles["lon"].to_numpy(), k)) for k in range(level + 1)]
    work = dict.fromkeys(np.unique(farfield.cell_of(points["lat"].to_numpy(), points["lon"].to_numpy(), level)).tolist(), 0)
    poles_of = dict(zip(*np.unique(cells, return_counts=True), strict=True))
    for _, far, b, c in farfield.interactions(np.array(list(work)), filled, level, 3.0):
        for block, cell in zip(b.tolist(), c.tolist(), strict=True):
            work[block] += 64 if far else poles_of[cell]
    assert np.mean(list(work.values())) < m / 3


def test_far_field_of_few_poles_and_frames(spark, monkeypatch):
    monkeypatch.setattr(farfield, "POLES_AT_ONCE", 3)
    monkeypatch.setattr(farfield, "POINTS_AT_ONCE", 2)
    rng = np.random.default_rng(52)
    poles = pd.DataFrame({"pole_idx": np.arange(40), "lat": np.append(rng.uniform(-90, 90, 30), np.full(10, 60.5)), "lon": np.append(rng.uniform(-180, 180, 30), np.full(10, 10.5))})
    points = pd.DataFrame({"point_idx": np.arange(25), "lat": np.append(rng.uniform(-90, 90, 20), np.full(5, 62.0)), "lon": np.append(rng.uniform(-180, 180, 20), np.full(5, 11.0))})
    amplitudes = pd.DataFrame([(f, p, float(a)) for f in (1, 2) for p, a in enumerate(rng.normal(0, 1e11, 40))], columns=["frame_id", "pole_idx", "amp"])
    frames = [spark.createDataFrame(x) for x in (points, poles, amplitudes)]
    want = field.predict(*frames).toPandas().sort_values(["frame_id", "point_idx"])[["i", "j", "k"]].to_numpy()
    got = farfield.predict_far(*frames, level=2, nodes=14).toPandas().sort_values(["frame_id", "point_idx"])[["i", "j", "k"]].to_numpy()
    assert got == pytest.approx(want, rel=1e-8, abs=1e-8 * np.abs(want).max())
    assert farfield.predict_far(frames[0].limit(0), *frames[1:]).collect() == []
    with pytest.raises(field.PoleError):
        farfield.predict_far(*frames[:2], frames[2].where("pole_idx > 0"))


def test_far_field_looks_at_no_more_poles_where_there_are_more(spark):
    """Leaves follow how close the poles are: near poles of a point don't grow with the poles."""
    rng = np.random.default_rng(54)
    near = []
    for m in (10_000, 160_000):
        lat, lon = rng.uniform(45, 85, m), rng.uniform(-170, 35, m)
        level = farfield.leaf_level(spark.createDataFrame(pd.DataFrame({"lat": lat, "lon": lon})))
        filled = [np.unique(farfield.cell_of(lat, lon, k)) for k in range(level + 1)]
        many = dict(zip(*np.unique(farfield.cell_of(lat, lon, level), return_counts=True), strict=True))
        blocks = np.unique(farfield.cell_of(lat[:50], lon[:50], level))
        near.append(sum(many[c] for _, far, _, cells in farfield.interactions(blocks, filled, level, 3.0) if not far for c in cells.tolist()) / len(blocks))
    assert max(near) < 8_000 and near[1] < 2 * near[0]


def test_matrix_between_distant_places_has_limits_opposite_a_pole():
    lat, lon = np.array([50.0, -40.0, -40.0000001, 10.0]), np.array([10.0, -150.0, -150.0, 30.0])
    poles = pd.DataFrame({"lat": [40.0, 41.0], "lon": [30.0, 30.0]})
    for altitude in (0.0, 110e3, 400e3):
        got = farfield.distant_matrix((lat, lon), (poles["lat"].to_numpy(), poles["lon"].to_numpy()), altitude, 110e3).reshape(4, 3, 2)
        want = factors.transfer_matrix(lat, lon, altitude, poles, 110e3).reshape(4, 3, 2)
        size = np.abs(want[0]).max()
        assert got[[0, 3]] == pytest.approx(want[[0, 3]], rel=1e-9) and got[:, :, 1] == pytest.approx(want[:, :, 1], rel=1e-9)
        assert np.isfinite(got).all() and np.abs(got[1] - got[2]).max() < 1e-8 * size


def test_predict_by_cells_equals_pair_by_pair(spark, monkeypatch):
    rng = np.random.default_rng(55)
    poles = pd.DataFrame({"pole_idx": np.arange(300), "lat": rng.uniform(45, 85, 300), "lon": rng.uniform(-170, 35, 300)})
    amplitudes = spark.createDataFrame(pd.DataFrame({"frame_id": 4, "pole_idx": np.arange(300), "amp": rng.normal(0, 1e11, 300)}))
    rows = [(n, float(a), float(b)) for n, (a, b) in enumerate(zip(rng.uniform(45, 85, 40), rng.uniform(-180, 540, 40), strict=True))]
    points = spark.createDataFrame([*rows, (40, None, 1.0), rows[0]], "point_idx long, lat double, lon double")
    want = {r.point_idx: r for r in field.predict(points, spark.createDataFrame(poles), amplitudes).collect()}
    monkeypatch.setattr(field, "FAR_PAIRS", 1_000)
    monkeypatch.setattr(field, "FAR_POLES", 10)
    monkeypatch.setattr(farfield, "POLES_OF_A_LEAF", 4)
    found = field.predict(points, spark.createDataFrame(poles), amplitudes)
    assert "CoGroup" in found._jdf.queryExecution().executedPlan().toString()
    got = {r.point_idx: r for r in found.collect()}
    assert sorted(got) == sorted(want) == list(range(41)) and all(r.frame_id == 4 for r in got.values())
    assert [got[40].i, got[40].j, got[40].k] == [want[40].i, want[40].j, want[40].k] == [None] * 3
    a, b = ([[r.i, r.j, r.k] for n, r in sorted(x.items()) if n < 40] for x in (got, want))
    assert np.abs(np.array(a) - b).max() <= 1e-9 * np.abs(b).max()


@pytest.mark.parametrize("lat, lon", [((52.0, 63.5), (-130.0, -55.0)), ((-90.0, 90.0), (170.0, 190.0)), ((80.0, 90.0), (0.0, 360.0)), ((10.0, 10.0), (530.0, 545.0)), ((5.0, 4.0), (0.0, 1.0)), ((-20.0, 20.0), (179.0, 180.0))])
def test_a_region_equals_a_filter(spark, tmp_path, lat, lon):
    rng = np.random.default_rng(53)
    rows = [(n, float(a), float(b)) for n, (a, b) in enumerate(zip(rng.uniform(-90, 90, 800).round(), rng.uniform(-180, 540, 800).round(), strict=True))]
    rows += [(1000, None, 1.0), (1001, 90.0, 180.0), (1002, -90.0, -180.0), (1003, 10.0, 180.0), (1004, float("nan"), 0.0)]
    table = spark.createDataFrame(rows, "point_idx long, lat double, lon double")
    for degrees in (45.0, 70.0):
        regions.write_cells(table, f"{tmp_path}/{degrees}", degrees)
        found = regions.read_region(spark, f"{tmp_path}/{degrees}", lat, lon, degrees)
        want = table.where(F.col("lat").between(*lat) & (F.pmod(F.col("lon") - lon[0], F.lit(360.0)) <= min(lon[1] - lon[0], 360.0)) & (F.lit(lon[1] >= lon[0])) & ~F.isnan("lat"))
        assert found.columns == table.columns
        assert sorted(r.point_idx for r in found.collect()) == sorted(r.point_idx for r in want.collect())
    with pytest.raises(ValueError):
        regions.write_cells(table.withColumn("cell_lat", F.lit(1)), f"{tmp_path}/x")


def test_a_region_reads_its_own_files(spark, tmp_path):
    table = spark.createDataFrame([(n, float(a), float(b)) for n, (a, b) in enumerate((a, b) for a in range(-75, 90, 30) for b in range(-165, 180, 30))], "point_idx long, lat double, lon double")
    regions.write_cells(table, f"{tmp_path}/cells", 30.0)
    found = regions.read_region(spark, f"{tmp_path}/cells", (40.0, 50.0), (-140.0, -100.0), 30.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell_lat" in plan and "cell_lon" in plan
    read = {r.f for r in found.select(F.input_file_name().alias("f")).distinct().collect()}
    assert found.count() == 2 and len(read) == 2


# Two matrices and their truncated pseudo-inverses (cutoff 0.05), which results must equal.
ONE_COLUMN = [
    -1.740219584057594e-14, -2.063846893630430e-14, -7.196789740341245e-15, -1.249155868086343e-14, -1.695818904037060e-14, -2.260086589981562e-15,
    -9.105042385762502e-15, -1.488743707273469e-14, 4.951651778613771e-16, -6.470234386398055e-15, -1.368218481923297e-14, 2.120640891125677e-15,
]
ONE_INVERSE = [
    -9.844820937276402e12, -1.167565478281233e13, -4.071388861840475e12, -7.066760974717956e12, -9.593636116521627e12, -1.278582771102278e12,
    -5.150931108655837e12, -8.422164279654078e12, 2.801262872271265e11, -3.660359849977943e12, -7.740325462951015e12, 1.199695144030031e12,
]
FOUR_COLUMNS = [
    6.827264853717463e-14, 9.689517718394877e-14, 4.750590192220720e-14, 5.109387420181284e-14,
    -4.235379862644485e-14, 5.933118429556925e-30, -1.188994785874325e-14, 3.128597474864381e-30,
    -5.801333306544970e-14, -7.435028445824706e-14, -2.746474094370104e-14, -2.949906202435753e-14,
    1.029209624918833e-14, 9.849135400444682e-15, 4.984896951419508e-14, 7.654964943601531e-14,
    -7.619581196376068e-14, -1.469577043150429e-13, -4.332805722881490e-14, -3.703381769963078e-14,
    -5.461510323377026e-14, -1.243912186379883e-13, -4.399344090250921e-14, -6.263786866121732e-14,
    -1.529317787688337e-14, -3.549064384959199e-14, 1.515077631500203e-14, 1.467917674496734e-14,
    -4.961348294564456e-14, -5.570147667694302e-14, -6.529077176559688e-14, -9.612852906727201e-14,
    -3.028994262796804e-14, -4.399344090250921e-14, -4.494903947820231e-14, -7.469424710631983e-14,
    -1.679131089590554e-14, -2.681911342757982e-14, -1.035067228718271e-14, -2.556627325533606e-14,
    -3.456686380796599e-14, -3.301269459917760e-14, -5.220307220143968e-14, -5.773737523700458e-14,
    -1.750630669003064e-14, -2.134917321240096e-14, -3.154322664941039e-14, -4.116250468023389e-14,
]
FOUR_INVERSE = [
    4.181245072508486e12, -1.464431263701310e13, -5.496216950246574e12, -3.054444689387419e12, 2.362529690873081e11, 6.233009520175254e12,
    2.364369877695222e11, -1.259231987541912e12, 2.213263730553430e12, 8.977996221789597e11, -3.212427148770240e12, 5.033174201230632e10,
    -5.374623046072026e11, 7.517903614410475e12, 1.195831669210517e12, -6.268184447810822e11, -3.838208120474751e12, -5.453743999201780e12,
    -1.955793240615901e12, 1.833089195211492e12, -2.912834112346965e11, -6.710643671299893e11, 2.555785231740496e12, 6.374114187769015e11,
    7.465719598816196e11, -2.961583055312898e12, -7.260074173813654e11, 1.257848045451077e12, 1.221292560767908e12, 1.534126225000792e12,
    1.073222580723768e12, -1.890277010633517e12, -7.727492037016722e11, 1.456241923723196e10, -1.773666969082516e12, -7.804318263285973e11,
    -1.207583736725345e12, 4.424831179324823e12, 2.081879672921097e12, 3.758405073367649e12, 1.380212852339987e12, -1.735823847470778e12,
    1.391468467085767e12, -2.192372081832731e12, -2.593936453888952e12, -5.795702120351111e11, -7.848844774712429e11, -1.246512560767249e12,
]


@pytest.mark.parametrize("cells, inverse, columns, error", [(ONE_COLUMN, ONE_INVERSE, 1, 1e-14), (FOUR_COLUMNS, FOUR_INVERSE, 4, 1e-10)])
def test_given_pseudo_inverses(spark, cells, inverse, columns, error):
    t, want = np.reshape(cells, (12, columns)), np.reshape(inverse, (columns, 12))
    assert field.pseudo_inverse(t, 0.05) == pytest.approx(want, rel=error)
    rows = spark.createDataFrame([("x", n, r) for n, r in enumerate(t.tolist())], "set_id string, row long, cells array<double>")
    for size in (20_000, 2):
        got = np.array([r.weights for r in factors.inverse_rows(rows, 0.05, slice_rows=size).orderBy("row").collect()]).T
        assert got == pytest.approx(want, rel=max(error, 1e-11))


def test_sets_that_differ_by_a_few_stations_are_updated(spark, tmp_path):
    rng = np.random.default_rng(57)
    at = [(float(a), float(b)) for a, b in zip(rng.uniform(40, 80, 40), rng.uniform(-170, 30, 40), strict=True)]
    poles = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(rng.uniform(45, 85, 9), rng.uniform(-170, 35, 9), strict=True))], "pole_idx long, lat double, lon double")
    store = Store(spark, f"{tmp_path}/store")

    def frames(*members):
        rows = [(f, n, *at[k], *map(float, rng.normal(0, 100, 3))) for f, own in enumerate(members) for n, k in enumerate(own)]
        return spark.createDataFrame(rows, "frame_id long, obs_idx long, lat double, lon double, i double, j double, k double")

    first = field.fitted(frames(range(20)), poles, store=store, changes=2)
    assert (first.made, first.updated) == (1, 0)
    # one less, one more, one twice, three others (too many), a set of its own, and one of few stations
    obs = frames(range(1, 20), range(21), [*range(20), 4], [*range(17), 21, 22, 23], range(20, 40), range(3))
    second = field.fitted(obs, poles, store=store, changes=2)
    assert (second.made, second.updated) == (3, 3)
    want = field.fit(obs, poles).toPandas().sort_values(["frame_id", "pole_idx"])["amp"].to_numpy()
    got = second.amplitudes().toPandas().sort_values(["frame_id", "pole_idx"])["amp"].to_numpy()
    assert len(got) == 54 and got == pytest.approx(want, rel=1e-8, abs=1e-8 * np.abs(want).max())
    # another cutoff is the same Gram matrix; the third set is one less than an updated one
    third = field.fitted(frames(range(20), range(2, 20)), poles, store=store, changes=2, cutoff=0.2)
    assert (third.made, third.updated) == (0, 2)
    assert field.fitted(frames(range(20)), poles, store=store, changes=2, pole_altitude=100e3).updated == 0
