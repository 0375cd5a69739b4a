"""Stations, poles and observations from the tables of a star schema, by arithmetic on their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telluric.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point_idx, lat, lon) from customers."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.cast("long").alias("point_idx"), (45.0 + (k * 37 % 401) / 10.0).alias("lat"), (-170.0 + (k * 91 % 2051) / 10.0).alias("lon"))


def poles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pole_idx, lat, lon) from suppliers."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.cast("long").alias("pole_idx"), (45.013 + (k * 53 % 397) / 10.0).alias("lat"), (-170.017 + (k * 71 % 2043) / 10.0).alias("lon"))


def observations(spark: SparkSession, sf_dir: str, also: tuple[str, ...] = ()) -> DataFrame:
    """(frame_id, obs_idx, lat, lon, i, j, k) from events, and columns of theirs besides: a frame is a day, a station a user."""
    k, sign = F.col("user_id"), 1.0 - 2.0 * (F.col("event_id") % 2)
    return table(spark, sf_dir, "events").select(
        F.dayofmonth("ts").cast("long").alias("frame_id"),
        F.col("event_id").cast("long").alias("obs_idx"),
        (45.0 + (k * 37 % 401) / 10.0).alias("lat"),
        (-170.0 + (k * 91 % 2051) / 10.0).alias("lon"),
        (sign * F.col("value")).alias("i"),
        (sign * F.col("value") * -0.5).alias("j"),
        (F.col("value") * 0.25).alias("k"),
        *also,
    )
