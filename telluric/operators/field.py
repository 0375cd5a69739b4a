"""Fit of current amplitudes to observations and prediction of the field.

Each pair of a point and a pole is one row of a broadcast nested-loop join, and is summed right above it by
partial aggregation: neither the transfer tensor nor any pair is stored or shuffled. The points are dealt out by the number
of pairs that they make. Poles are broadcast only up to MOST_POLES of them (some 30 MB), fewer where each carries the
amplitudes of many frames; beyond, Spark deals out both sides.

A fit factors each set of stations once, however many frames it has (operators.factors). Its frames are coordinates in the bases of
their sets, and so are predicted: the kernel is brought to a basis once, not to each frame.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telluric.functions import sphere, transfer
from telluric.operators.factors import (
    CELLS, FitError, Stations, bases_of, binary, factored, grouped, in_tree, matrix, nearest_sets, pseudo_inverse, summed, transfer_matrix, updated_grams, whole_grams,
)
from telluric.sources.schemas import CUTOFF, POINT_ALTITUDE, POLE_ALTITUDE, STATION_ALTITUDE
from telluric.sources.scratch import folder, saved
from telluric.sources.store import Store

__all__ = ["FitError", "PoleError", "Fitted", "fit", "fit_single_pole", "fit_two_poles", "fitted", "flattened", "pairs", "predict", "pseudo_inverse", "transfer_matrix", "transfer_rows", "without_k"]

MOST_POLES = 500_000
MOST_GRAM = 4_000
#: Transfer matrices are fitted times this, which brings them near 1.
SCALE = 1e15
FRAMES_AT_ONCE = 200
SETS_AT_ONCE = 32
ROWS_AT_ONCE = 200_000
PAIRS_AT_ONCE = 1_000_000
#: Tasks that a stage is dealt to at most: beyond, each gets more.
MOST_TASKS = 20_000
#: Pairs that are written come by place beyond so many: among fewer, neighbours have few values in common.
PAIRS_BY_PLACE = 2_000_000_000
#: Pairs of a unit that is laid out by place, and the units that there may be of fewer (PAIRS_AT_ONCE at least).
PAIRS_OF_A_UNIT, SMALL_UNITS = 10_000_000, 200
#: predict goes by cells of poles (operators.farfield) beyond so many pairs and poles, with so many nodes a side.
FAR_PAIRS, FAR_POLES, FAR_NODES = 200_000_000, 1_000, 16
#: Fitted frames are predicted by their amplitudes at so many poles: a basis isn't much narrower.
FEW_POLES = 8


class PoleError(ValueError):
    """Amplitudes that don't belong to the poles."""


def pairs(points: DataFrame, poles: DataFrame, point_keys: list[str], pole_keys: list[str], clamp: bool = False, most: int = MOST_POLES, by_place: bool = False) -> DataFrame:
    """Every point with every pole: the keys, theta and alpha (angle to the pole and its bearing).

    by_place is for pairs that are written: beyond PAIRS_BY_PLACE they come in an order that takes a fraction of the bytes.
    """
    a, b = sphere.with_trig(points, "p"), sphere.with_trig(poles, "s")
    left, right = [*point_keys, "p_sin", "p_cos", "p_lon"], [*pole_keys, "s_sin", "s_cos", "s_lon"]
    if by_place and (n := points.count()) * (k := poles.count()) > PAIRS_BY_PLACE:
        joined = _by_place(a, b, left, right, n, k)
    else:
        a, b = a.select(*left), b.select(*right)
        m = poles.limit(most + 1).count()
        if m <= most:
            # a nested-loop join keeps the partitions of the side that isn't broadcast, and those follow the size of its file
            parts = min(MOST_TASKS, -(-points.count() * m // PAIRS_AT_ONCE))
            joined = (a.repartition(parts) if parts > 1 else a).crossJoin(F.broadcast(b))
        else:
            joined = a.crossJoin(b)
    return joined.select(*point_keys, *pole_keys, sphere.angle("p", "s", clamp).alias("theta"), sphere.bearing("p", "s").alias("alpha"))


def _by_place(points: DataFrame, poles: DataFrame, left: list[str], right: list[str], n: int, m: int) -> DataFrame:
    """Each of n points with each of m poles (their columns left and right), in units of a block of neighbouring points and a part of neighbouring poles: pole by pole, each with the points from West to East.

    The points' keys are then the same sequence for each pole, a pole's key is one run, and where places keep to a grid a pole sees the angles of the pole next to it, some places on. Nothing is
    broadcast; each point is sent once for every part and each pole once for every block. These are chosen so that both come to the same.
    """
    units = max(1, min(MOST_TASKS // 4, max(-(-n * m // PAIRS_OF_A_UNIT), min(-(-n * m // PAIRS_AT_ONCE), SMALL_UNITS))))
    blocks = max(1, min(n, units, round(math.sqrt(units * n / max(1, m)))))
    parts = -(-units // blocks)

    def placed(df: DataFrame, columns: list[str], own: str, count: int, other: str, others: int) -> DataFrame:
        by = ["lat", "lon", *(c for c in columns if c not in ("lat", "lon"))]
        near = df.repartitionByRange(count, *by).sortWithinPartitions(*by).withColumn(own, F.spark_partition_id())
        sent = near.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return sent.select((F.col("in_block").cast("long") * parts + F.col("in_part")).alias("unit"), *columns).repartition(4 * units, "unit")  # so that few units share a task, where their poles would take turns

    sent = placed(points, left, "in_block", blocks, "in_part", parts)
    return placed(poles, right, "in_part", parts, "in_block", blocks).join(sent.hint("shuffle_hash"), "unit")


def transfer_rows(
    points: DataFrame, point_altitude: float, poles: DataFrame, pole_altitude: float, point_keys: list[str], pole_keys: list[str], clamp: bool = False, most: int = MOST_POLES, by_place: bool = False
) -> DataFrame:
    """The keys and t_i, t_j, t_k of every pair."""
    t = transfer.components(F.col("theta"), F.col("alpha"), point_altitude, pole_altitude)
    return pairs(points, poles, point_keys, pole_keys, clamp, most, by_place).select(*point_keys, *pole_keys, *(c.alias(n) for c, n in zip(t, ("t_i", "t_j", "t_k"), strict=True)))


def without_k(observations: DataFrame) -> DataFrame:
    """Observations with the vertical component set to 0."""
    return observations.withColumn("k", F.lit(0.0))


def flattened(observations: DataFrame) -> DataFrame:
    """(frame_id, row, value): the components as one vector by frame; row is three times obs_idx plus 0, 1 or 2."""
    return observations.select("frame_id", "obs_idx", F.posexplode(F.array("i", "j", "k")).alias("pos", "value")).select(
        "frame_id", (F.col("obs_idx") * 3 + F.col("pos")).alias("row"), "value"
    )


def fit_single_pole(observations: DataFrame, pole: DataFrame, *, altitude: float = STATION_ALTITUDE, pole_altitude: float = POLE_ALTITUDE) -> DataFrame:
    """(frame_id, pole_idx, amp) for each pole alone: the pseudo-inverse of one column in closed form, by frame."""
    t = transfer_rows(observations, altitude, pole, pole_altitude, ["frame_id", "i", "j", "k"], ["pole_idx"])
    b, square = (reduce(Column.__add__, (F.col(f"t_{c}") * F.col(x) for c, x in zip("ijk", names, strict=True))) for names in ("ijk", ("t_i", "t_j", "t_k")))
    return t.groupBy("frame_id", "pole_idx").agg((F.sum(b) / F.nullif(F.sum(square), F.lit(0.0))).alias("amp"))


def fit_two_poles(observations: DataFrame, first: DataFrame, second: DataFrame, *, altitude: float = STATION_ALTITUDE, pole_altitude: float = POLE_ALTITUDE, cutoff: float = CUTOFF) -> DataFrame:
    """(frame_id, amp_a, amp_b): the truncated pseudo-inverse of two columns in closed form, by frame.

    first and second have one pole each; the singular values are roots of the 2 x 2 Gram matrix's eigenvalues.
    """
    if first.limit(2).count() != 1 or second.limit(2).count() != 1:
        raise FitError("two poles are fitted, one from each table")
    a = sphere.with_trig(first, "a").select("a_sin", "a_cos", "a_lon")
    b = sphere.with_trig(second, "b").select("b_sin", "b_cos", "b_lon")
    rows = sphere.with_trig(observations, "p").crossJoin(F.broadcast(a)).crossJoin(F.broadcast(b))
    ta, tb = (transfer.components(sphere.angle("p", s), sphere.bearing("p", s), altitude, pole_altitude) for s in "ab")
    rows = rows.select("frame_id", "i", "j", "k", *(c.alias(f"{s}{n}") for s, t in (("a", ta), ("b", tb)) for n, c in enumerate(t)))

    def dot(x: list[str], y: list[str]) -> Column:
        return F.sum(reduce(Column.__add__, (F.col(p) * F.col(q) * F.lit(1e30) for p, q in zip(x, y, strict=True))))

    va, vb, o = ["a0", "a1", "a2"], ["b0", "b1", "b2"], ["i", "j", "k"]
    g = rows.groupBy("frame_id").agg(dot(va, va).alias("p"), dot(vb, vb).alias("r"), dot(va, vb).alias("q"), (dot(va, o) * 1e-15).alias("x"), (dot(vb, o) * 1e-15).alias("y"))
    middle, half = (F.col("p") + F.col("r")) / 2, F.sqrt(F.pow((F.col("p") - F.col("r")) / 2, F.lit(2.0)) + F.col("q") * F.col("q"))
    g = g.withColumns({"l1": middle + half, "l2": middle - half})
    # the projection on the larger eigenvalue's space is (G - l2) / (l1 - l2), on the smaller one's (l1 - G) / (l1 - l2)
    gap = F.nullif(F.col("l1") - F.col("l2"), F.lit(0.0))
    keep = F.when(F.col("l2") >= cutoff * cutoff * F.col("l1"), 1.0 / F.nullif(F.col("l2"), F.lit(0.0))).otherwise(0.0)
    gx, gy = F.col("p") * F.col("x") + F.col("q") * F.col("y"), F.col("q") * F.col("x") + F.col("r") * F.col("y")

    def amp(v: Column, gv: Column) -> Column:
        return ((gv - F.col("l2") * v) / gap / F.nullif(F.col("l1"), F.lit(0.0)) + (F.col("l1") * v - gv) / gap * keep) * 1e15

    return g.select("frame_id", amp(F.col("x"), gx).alias("amp_a"), amp(F.col("y"), gy).alias("amp_b"))


@dataclass(frozen=True)
class Fitted:
    """Fitted frames, as coordinates in the basis of each one's set of stations.

    frames: frame_id, set_id, chunk, side; factors: set_id, basis. grid has the poles in the order of the bases' rows; made is the number
    of sets that were factored for this fit, updated that of those whose Gram matrix came from a kept one.
    """

    frames: DataFrame
    factors: DataFrame
    grid: pd.DataFrame
    pole_altitude: float
    scale: float
    made: int = 0
    updated: int = 0

    def _parts(self) -> int:
        return min(20_000, 2 * max(1, self.frames.select("set_id", "chunk").distinct().count()))

    def amplitudes(self) -> DataFrame:
        """(frame_id, pole_idx, amp) at all poles."""
        m, grid, scale, parts = len(self.grid), self.grid, self.scale, self._parts()

        def run(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if not len(own):
                return pd.DataFrame({"frame_id": [], "pole_idx": [], "amp": []})
            amp = matrix(b"".join(own["side"]), len(own["side"].iloc[0]) // 8) @ np.frombuffer(held["basis"].iloc[0], "<f8").reshape(m, -1).T * scale
            return pd.DataFrame({"frame_id": np.repeat(own["frame_id"].to_numpy(), m), "pole_idx": np.tile(grid["pole_idx"].to_numpy(), len(own)), "amp": amp.reshape(-1)})

        spread = self.factors.join(self.frames.select("set_id", F.col("chunk").alias("chunk")).distinct(), "set_id")
        found = grouped(self.frames, parts, "set_id", "chunk").cogroup(grouped(spread, parts, "set_id", "chunk"))
        return found.applyInPandas(run, "frame_id long, pole_idx long, amp double")

    def predict(self, points: DataFrame, *, altitude: float = POINT_ALTITUDE) -> DataFrame:
        """(frame_id, point_idx, lat, lon, i, j, k): the field at points (point_idx, lat, lon) in all frames.

        The kernel at a point is computed once for every SETS_AT_ONCE sets and brought to each one's basis, which has a few dozen columns; a frame then costs a
        product with its coordinates, however many poles there are. At FEW_POLES or fewer, frames of all sets share the kernel, by their amplitudes, and nothing
        is stored for each set. Points or frames that are missing give no rows.
        """
        m, path, scale = len(self.grid), folder(points.sparkSession), self.scale
        if m <= FEW_POLES:
            return _at_once(points, self.grid, self.amplitudes(), self.frames.count(), altitude, self.pole_altitude)
        make = Stations(self.grid, altitude, self.pole_altitude, scale)
        n, sets, frames = points.count(), self.factors.count(), self.frames.count()
        blocks = max(1, -(-n * m // CELLS), -(-n * min(frames, FRAMES_AT_ONCE) // ROWS_AT_ONCE))
        groups = max(1, -(-sets // SETS_AT_ONCE))
        every = lambda df, name, k: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        placed = every(points.select("point_idx", "lat", "lon", F.pmod(F.xxhash64("point_idx"), F.lit(blocks)).cast("int").alias("block")), "group", groups)
        spread = every(self.factors.withColumn("group", F.pmod(F.xxhash64("set_id"), F.lit(groups)).cast("int")), "block", blocks)

        def project(key: tuple, own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if not len(own) or not len(held):
                return pd.DataFrame({"set_id": [], "block": [], "ids": [], "lat": [], "lon": [], "projected": []}, dtype=object)
            bases = [np.frombuffer(b, "<f8").reshape(m, -1) for b in held["basis"]]
            parts = [[t @ b for b in bases] for _, t in make.batches(own, finite=False)]
            projected = [binary(np.concatenate([p[k] for p in parts])) for k in range(len(bases))]
            same = {name: [own[c].to_numpy()] * len(bases) for name, c in (("ids", "point_idx"), ("lat", "lat"), ("lon", "lon"))}
            return pd.DataFrame({"set_id": held["set_id"], "block": key[0], **same, "projected": projected})

        parts = min(20_000, 2 * blocks * groups)
        kind = "set_id string, block int, ids array<long>, lat array<double>, lon array<double>, projected binary"
        found = grouped(placed, parts, "block", "group").cogroup(grouped(spread, parts, "block", "group")).applyInPandas(project, kind)
        found = saved(found, f"{path}/projected")
        chunks = every(self.frames.groupBy("set_id", "chunk").agg(F.collect_list(F.struct("frame_id", "side")).alias("frames")), "block", blocks)
        parts = min(20_000, 2 * blocks * max(1, sets))
        units = found.repartition(parts, "set_id", "block").join(chunks.repartition(parts, "set_id", "block"), ["set_id", "block"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    row = batch.slice(at, 1)
                    ids, lat, lon = (row[c].flatten() for c in ("ids", "lat", "lon"))
                    frame = row["frames"][0].as_py()
                    sides = np.stack([np.frombuffer(x["side"], "<f8") for x in frame], axis=1)
                    values = np.frombuffer(row["projected"][0].as_buffer(), "<f8").reshape(3 * len(ids), -1) @ sides
                    yield _field_rows(frame, ids, lat, lon, values.reshape(len(ids), 3, -1))

        return units.select("ids", "lat", "lon", "projected", "frames").mapInArrow(run, FIELD)


FIELD = "frame_id long, point_idx long, lat double, lon double, i double, j double, k double"


def _field_rows(frames: list[dict], ids: pa.Array, lat: pa.Array, lon: pa.Array, values: np.ndarray) -> pa.RecordBatch:
    """Rows of FIELD of values by point, component and frame."""
    n = len(frames)
    at = pa.array(np.tile(np.arange(len(ids)), n))
    columns = [pa.array(np.repeat(np.array([x["frame_id"] for x in frames], np.int64), len(ids))), *(c.take(at) for c in (ids, lat, lon))]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array(values[:, k].T.reshape(-1)) for k in range(3))], ["frame_id", "point_idx", "lat", "lon", "i", "j", "k"])


def pole_grid(poles: DataFrame) -> pd.DataFrame:
    """The poles in order, for the rows of bases."""
    grid = poles.select("pole_idx", "lat", "lon").orderBy("pole_idx").limit(MOST_POLES + 1).toPandas()
    if not 0 < len(grid) <= MOST_POLES:
        raise FitError(f"a fit needs 1 to {MOST_POLES} poles")
    return grid


def setting_of(grid: pd.DataFrame, *numbers: float) -> str:
    """What poles and numbers make a factorisation one's own."""
    return hashlib.sha256(grid.to_numpy("<f8").tobytes() + repr(numbers).encode()).hexdigest()


def _by_neighbours(store: Store, stations: DataFrame, make: Stations, setting: str, cutoff: float, changes: int, slices: int, tasks: int, path: str) -> tuple[DataFrame, int, DataFrame]:
    """(set_id and basis of sets with many stations, how many of them were updated from a kept one, the stations of the other sets).

    Their Gram matrices and stations are added to the store.
    """
    many = saved(stations.where(F.col("stations") >= make.columns()), f"{path}/many")
    members = many.select("set_id", "lat", "lon", "n")
    known, grams, fresh, updated = store.parts("members"), store.parts("grams"), many, 0
    found = None
    if known is not None and grams is not None:
        own = F.col("setting") == setting
        nearest = nearest_sets(members, known.where(own).select("set_id", "lat", "lon", "n").distinct(), changes, path)
        updated = nearest.select("set_id").distinct().count()
        found = updated_grams(nearest, grams.where(own).dropDuplicates(["set_id"]).select("set_id", "gram"), make, tasks)
        fresh = many.join(nearest.select("set_id").distinct(), "set_id", "left_anti")
    new = whole_grams(fresh, make, slices=slices, tasks=tasks)
    new = saved(new if found is None else new.union(found), f"{path}/grams")
    store.add("members", members.withColumn("setting", F.lit(setting)))
    store.add("grams", new.withColumn("setting", F.lit(setting)))
    return bases_of(new, make.columns(), cutoff), updated, stations.where(F.col("stations") < make.columns())


def fitted(
    observations: DataFrame,
    poles: DataFrame,
    *,
    altitude: float = STATION_ALTITUDE,
    pole_altitude: float = POLE_ALTITUDE,
    cutoff: float = CUTOFF,
    slice_rows: int = 20_000,
    scale: float = SCALE,
    most_gram: int = MOST_GRAM,
    width: int = 96,
    store: Store | None = None,
    changes: int = 0,
) -> Fitted:
    """Frames fitted at all poles by the truncated pseudo-inverse.

    Frames with the same stations, each as often, share a factorisation, see operators.factors. With a store, factorisations are kept there
    by what they follow from (places of the stations and how often each occurs, poles, both altitudes, cutoff), and those that it has are not made
    again. Observations at one place in a frame are added up first; where observations have a column n, a row is the sum of so many already. The poles go to every task, MOST_POLES of them at most. A NaN in the
    matrix or the values raises FitError. Rows without a place or a frame are left out.

    With a store and changes above 0, the Gram matrices of sets with as many stations as poles or more (poles up to
    most_gram, cutoff of 1e-6 or more) are kept too: a set that differs from a kept one in at most changes stations gets its own by
    adding and taking away their rows, without a pass over its other stations.
    """
    spark = observations.sparkSession
    grid = pole_grid(poles)
    m, path = len(grid), folder(spark)
    make = Stations(grid, altitude, pole_altitude, scale)
    # repeated stations of a frame are summed first: their rows of T are the same
    count = F.sum("n") if "n" in observations.columns else F.count("*")
    rows = observations.where("frame_id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    rows = saved(rows.groupBy("frame_id", "lat", "lon").agg(count.alias("n"), *(F.sum(c).alias(c) for c in "ijk")), f"{path}/rows")
    place, setting = ("lat", "lon", "n"), setting_of(grid, altitude, pole_altitude, scale, cutoff)
    frames = rows.groupBy("frame_id").agg(F.count("*").alias("stations"), *(F.bit_xor(F.xxhash64(F.lit(k), *place)).alias(f"x{k}") for k in (1, 2, 3)))
    frames = frames.select("frame_id", "stations", F.sha2(F.concat_ws(":", "stations", "x1", "x2", "x3", F.lit(setting)), 256).alias("set_id"))
    firsts = frames.groupBy("set_id", "stations").agg(F.min("frame_id").alias("frame_id"), F.ceil(F.count("*") / FRAMES_AT_ONCE).cast("int").alias("chunks"))
    frames = saved(frames.join(firsts.select("set_id", "chunks"), "set_id").withColumn("chunk", F.pmod(F.xxhash64("frame_id"), F.col("chunks")).cast("int")), f"{path}/frames")
    firsts = saved(firsts, f"{path}/sets")
    part = F.pmod(F.xxhash64("lat", "lon"), F.ceil(F.col("stations") / slice_rows)).cast("int").alias("slice")
    units, slices, made = firsts.agg(F.sum(F.ceil(F.col("stations") / slice_rows) * F.col("chunks")), F.max(F.ceil(F.col("stations") / slice_rows)), F.count("*")).first()
    parts = min(20_000, 2 * (units or 1))

    known = store.parts("factors") if store else None
    missing, updated = firsts, 0
    if known is not None:
        missing = saved(firsts.join(known, "set_id", "left_anti"), f"{path}/missing")
        made = missing.count()
    if made or known is None:
        stations = rows.join(missing, "frame_id").select("set_id", "stations", part, "lat", "lon", "n")
        derived = None
        if store and changes and m <= most_gram and cutoff >= 1e-6:
            derived, updated, stations = _by_neighbours(store, stations, make, setting_of(grid, altitude, pole_altitude, scale), cutoff, changes, int(slices or 1), parts, path)
            made -= updated
        new = factored(stations, make, cutoff, slice_rows=slice_rows, slices=int(slices or 1), tasks=parts, most_gram=most_gram, width=width)
        new = new if derived is None else new.union(derived)
        if store:
            known = store.add("factors", new)
        else:
            factors = saved(new, f"{path}/factors")
    if store:
        # the same set may have been added by two writers at once
        factors = saved(known.join(firsts.select("set_id"), "set_id", "left_semi").dropDuplicates(["set_id"]), f"{path}/factors")

    def sides(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        """Each frame's coordinates in its set's basis, of one slice of its stations."""
        if not len(own):
            return pd.DataFrame({"frame_id": [], "slice": [], "side": []})
        basis = np.frombuffer(held["basis"].iloc[0], "<f8").reshape(m, -1)
        out, parts_of = [], make.batches if m <= most_gram else make.passes
        for frame, some in own.groupby("frame_id", sort=False):
            b = some[["i", "j", "k"]].to_numpy().reshape(-1)
            if not np.isfinite(b).all():
                raise FitError(f"frame {frame}: NaN in the observations")
            out.append((frame, int(own["slice"].iloc[0]), binary(sum((t @ basis).T @ b[3 * at.start : 3 * at.stop] for at, t in parts_of(some)))))
        return pd.DataFrame(out, columns=["frame_id", "slice", "side"])

    chunk, kind = ["set_id", "chunk"], "frame_id long, slice int, side binary"
    seen = rows.join(frames, "frame_id").select(*chunk, part, "frame_id", "lat", "lon", "i", "j", "k")
    spread = firsts.join(factors, "set_id").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cut = spread.withColumn("slice", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("stations") / slice_rows) - 1).cast("int"))))
    found = grouped(seen, parts, *chunk, "slice").cogroup(grouped(cut, parts, *chunk, "slice")).applyInPandas(sides, kind)
    found = in_tree(found, ["frame_id"], summed("side"), kind, int(slices or 1), parts).drop("slice")
    frames = saved(found.join(frames, "frame_id").select("frame_id", *chunk, "side"), f"{path}/sides")
    return Fitted(frames, factors, grid, pole_altitude, scale, made, updated)


def fit(observations: DataFrame, poles: DataFrame, **options) -> DataFrame:
    """(frame_id, pole_idx, amp): amplitudes at all poles by frame; see fitted."""
    return fitted(observations, poles, **options).amplitudes()


def check_poles(poles: DataFrame, amplitudes: DataFrame) -> tuple[int, int]:
    """How many poles and frames there are; every frame has one amplitude for each pole, and for no other."""
    m = poles.count()
    known = amplitudes.join(poles.select("pole_idx", F.lit(1).alias("known")), "pole_idx", "left")
    sizes = known.groupBy("frame_id").agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("known") == 1, F.col("pole_idx"))).alias("k"))
    frames, wrong = sizes.agg(F.count("*"), F.first(F.when(F.expr(f"n <> {m} OR k <> {m}"), F.struct("frame_id", "n", "k")), ignorenulls=True)).first()
    if wrong:
        raise PoleError(f"frame {wrong['frame_id']}: {wrong['n']} amplitudes, {wrong['k']} of them of the {m} poles")
    return m, frames


def _at_once(points: DataFrame, grid: pd.DataFrame, amplitudes: DataFrame, frames: int, altitude: float, pole_altitude: float) -> DataFrame:
    """predict for many frames: blocks of points against the amplitudes of some frames, as products of matrices; grid: the poles in the order of their numbers."""
    m, make = len(grid), Stations(grid, altitude, pole_altitude, 1.0)
    chunks = max(1, -(-frames // max(1, min(FRAMES_AT_ONCE, CELLS // m))))
    n = points.count()
    blocks = max(1, -(-n * m // CELLS), -(-n * -(-frames // chunks) // ROWS_AT_ONCE))
    by = F.struct("point_idx", "lat", "lon")
    placed = points.groupBy(F.pmod(F.xxhash64("point_idx"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(by).alias("points"))
    # pole by pole in the order of the grid: each frame has them all
    rows = amplitudes.groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pole_idx", "amp"))), lambda x: x["amp"]).alias("amp"))
    given = rows.groupBy(F.pmod(F.xxhash64("frame_id"), F.lit(chunks)).cast("int").alias("chunk")).agg(F.collect_list(F.struct("frame_id", "amp")).alias("frames"))
    parts = min(20_000, 2 * blocks * chunks)
    left = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition(parts, "block", "chunk")
    right = given.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(parts, "block", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                own, frame = batch["points"].slice(at, 1).flatten(), batch["frames"].slice(at, 1).flatten()
                amp = frame.field("amp").flatten().to_numpy().reshape(len(frame), m).T
                place = pd.DataFrame({"lat": own.field("lat").to_numpy(), "lon": own.field("lon").to_numpy()})
                values = np.concatenate([t @ amp for _, t in make.batches(place, finite=False)])
                yield _field_rows([{"frame_id": x.as_py()} for x in frame.field("frame_id")], own.field("point_idx"), own.field("lat"), own.field("lon"), values.reshape(len(own), 3, -1))

    return left.join(right, ["block", "chunk"]).select("points", "frames").mapInArrow(run, FIELD)


def _on_sphere(places: DataFrame) -> int:
    """How many places there are; 0 if one isn't on the sphere, where cells have no meaning."""
    n, low, high, around = places.agg(F.count("*"), F.min("lat"), F.max("lat"), F.max(F.abs("lon"))).first()
    return n if None not in (low, high, around) and -90 <= low and high <= 90 and around < 1e6 else 0


def predict(points: DataFrame, poles: DataFrame, amplitudes: DataFrame, *, altitude: float = POINT_ALTITUDE, pole_altitude: float = POLE_ALTITUDE) -> DataFrame:
    """(frame_id, point_idx, lat, lon, i, j, k): the field at each point and frame.

    points: point_idx, lat, lon; poles: pole_idx, lat, lon; amplitudes: frame_id, pole_idx, amp, which are computed once. A frame whose amplitudes aren't
    those of the poles, one each, raises PoleError; without any frame there is no field and no row. Frames that were fitted here are
    predicted at less cost by Fitted.predict.

    One frame's pairs beyond FAR_PAIRS are not made one by one: predict_far takes distant poles together, to some 1e-12 of their field.
    """
    amplitudes = saved(amplitudes.select("frame_id", "pole_idx", "amp"), f"{folder(points.sparkSession)}/amplitudes")
    m, n = check_poles(poles, amplitudes)
    if n > 1 and m <= MOST_POLES:
        return _at_once(points, poles.select("pole_idx", "lat", "lon").orderBy("pole_idx").toPandas(), amplitudes, n, altitude, pole_altitude)
    if n == 1 and m > FAR_POLES and _on_sphere(points) * m > FAR_PAIRS and _on_sphere(poles):
        from telluric.operators.farfield import predict_far  # which builds on this module

        found = predict_far(points, poles, amplitudes, altitude=altitude, pole_altitude=pole_altitude, nodes=FAR_NODES)
        nowhere = points.where("lat IS NULL OR lon IS NULL").select("point_idx", "lat", "lon").distinct().crossJoin(amplitudes.select("frame_id").distinct())
        return found.union(nowhere.select("frame_id", "point_idx", "lat", "lon", *(F.lit(None).cast("double").alias(c) for c in "ijk")))
    rows = transfer_rows(points, altitude, poles.join(amplitudes, "pole_idx"), pole_altitude, ["point_idx", "lat", "lon"], ["frame_id", "amp"])
    return rows.groupBy("frame_id", "point_idx", "lat", "lon").agg(*(F.sum(F.col("amp") * F.col(f"t_{c}")).alias(c) for c in "ijk"))
