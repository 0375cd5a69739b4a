"""Grids of points, made by Spark from a range of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def check_range(start: float, end: float) -> None:
    if end <= start:
        raise ValueError("the end of a range must be above its start")


def even(start: float, end: float, steps: int, k: Column) -> Column:
    """The k-th of steps even values from start to end."""
    check_range(start, end)
    return F.lit(start) + k * F.lit((end - start) / (steps - 1) if steps > 1 else 0.0)


def linspace(spark: SparkSession, start: float, end: float, steps: int) -> DataFrame:
    """(idx, value): steps even values, none or one for 0 or 1 steps."""
    return spark.range(max(0, steps)).select(F.col("id").alias("idx"), even(start, end, steps, F.col("id")).alias("value"))


def geographical_grid(spark: SparkSession, lats: tuple[float, float], lat_steps: int, lons: tuple[float, float], lon_steps: int) -> DataFrame:
    """(idx, lat, lon) of a grid, by latitude and then longitude."""
    k = F.col("id")
    return spark.range(max(0, lat_steps) * max(0, lon_steps)).select(
        k.alias("idx"),
        even(*lats, lat_steps, F.floor(k / F.lit(max(1, lon_steps)))).alias("lat"),
        even(*lons, lon_steps, k % F.lit(max(1, lon_steps))).alias("lon"),
    )


def nearest_node(lat: Column, lon: Column, lats: tuple[float, float], lat_steps: int, lons: tuple[float, float], lon_steps: int) -> Column:
    """The idx of the grid point next to a point, by latitude and longitude; points outside go to the border."""

    def step(x: Column, start: float, end: float, steps: int) -> Column:
        check_range(start, end)
        return F.least(F.greatest(F.round((x - start) / F.lit((end - start) / (steps - 1))), F.lit(0.0)), F.lit(float(steps - 1))).cast("long")

    return step(lat, *lats, lat_steps) * F.lit(lon_steps) + step(lon, *lons, lon_steps)
