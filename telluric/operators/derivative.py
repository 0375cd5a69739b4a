"""Derivative vectors: how fast the components change at each station."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def derivatives(observations: DataFrame, *, gap: float = 600.0, unit: float = 60.0, block: float | None = None) -> DataFrame:
    """(frame_id, obs_idx, ts, lat, lon, i, j, k): the change of i, j and k by unit seconds since the station's observation before.

    observations: frame_id, obs_idx, ts (timestamp), lat, lon, i, j, k. A station is a place; what it has at one instant is averaged, under its
    smallest frame and number. The observation before is the latest one within gap seconds; where there is none (a station's first
    instant, or one after a gap) there is no row. Rows without a time or a place are left out, null components stay null.

    Time is cut into blocks of block seconds (64 gaps if not given), and what lies within a gap of a block's end is read by the next block too: so
    a station's rows of all times never meet in one task.
    """
    if gap <= 0 or unit <= 0:
        raise ValueError("gap and unit are above 0")
    wide, long = round(gap * 1e6), round((block or 64 * gap) * 1e6)
    if long < wide:
        raise ValueError("a block is as long as a gap at least")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = observations.where("ts IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").groupBy("lat", "lon", t.alias("t"))
    rows = rows.agg(F.min("ts").alias("ts"), F.min("frame_id").alias("frame_id"), F.min("obs_idx").alias("obs_idx"), *(F.avg(c).alias(c) for c in "ijk"))
    own = F.floor(F.col("t") / F.lit(long))
    near_end = F.col("t") >= (own + 1) * long - wide
    rows = rows.withColumn("own", own).withColumn("block", F.explode(F.when(near_end, F.array("own", F.col("own") + 1)).otherwise(F.array("own"))))
    before = Window.partitionBy("lat", "lon", "block").orderBy("t").rangeBetween(-wide, -1)
    rows = rows.withColumn("before", F.last(F.struct("t", "i", "j", "k")).over(before)).where("block = own AND before IS NOT NULL")
    seconds = (F.col("t") - F.col("before.t")) / F.lit(unit * 1e6)
    return rows.select("frame_id", "obs_idx", "ts", "lat", "lon", *(((F.col(c) - F.col(f"before.{c}")) / seconds).alias(c) for c in "ijk"))
