"""Tables of places stored by cell of latitude and longitude, so that a region is read from its own files."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_OF_A_FILE = 1_000_000
CELLS = ("cell_lat", "cell_lon")


def _cells(degrees: float) -> tuple[Column, Column]:
    row = F.least(F.floor((F.col("lat") + 90.0) / degrees), F.lit(math.ceil(180 / degrees) - 1))
    column = F.least(F.floor(F.pmod(F.col("lon") + 180.0, F.lit(360.0)) / degrees), F.lit(math.ceil(360 / degrees) - 1))
    return row.cast("int"), column.cast("int")


def write_cells(rows: DataFrame, path: str, degrees: float = 10.0) -> None:
    """rows (with lat, lon in degrees, any longitude convention) as Parquet in a folder for each cell of so many degrees.

    Rows are brought together by cell first, large cells in several parts, so that a cell has few files. Rows without a place are not written.
    Columns named cell_lat or cell_lon are refused.
    """
    if set(CELLS) & set(rows.columns):
        raise ValueError(f"columns {' and '.join(CELLS)} are those of the cells")
    placed = rows.where("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)")
    placed = placed.withColumns(dict(zip(CELLS, _cells(degrees), strict=True))).hint("rebalance", *CELLS)
    placed.write.mode("overwrite").option("maxRecordsPerFile", ROWS_OF_A_FILE).partitionBy(*CELLS).parquet(path)


def read_region(spark: SparkSession, path: str, lat: tuple[float, float], lon: tuple[float, float], degrees: float = 10.0) -> DataFrame:
    """The rows of write_cells within a box, ends included; only the files of its cells are read.

    lon goes East from its first to its second value, also across 180 degrees, and is taken modulo 360; a difference of 360 or more is all around.
    degrees are those that were written with.
    """
    rows = spark.read.parquet(path)
    low, high = (math.floor((min(90.0, max(-90.0, x)) + 90.0) / degrees) for x in lat)
    west, wide = (lon[0] + 180.0) % 360.0, lon[1] - lon[0]
    if lat[1] < lat[0] or wide < 0:
        return rows.where(F.lit(False)).drop(*CELLS)
    cells, inside = F.col("cell_lat").between(low, high), F.col("lat").between(*lat)
    if wide < 360:
        columns = math.ceil(360 / degrees)
        first, last = math.floor(west / degrees), math.floor((west + wide) / degrees)
        # of a last cell that is narrower, and of rounding, the next one more is read
        wanted = sorted({k % columns for k in range(first, last + 2)} | {0} if west + wide >= 360 else set(range(first, last + 1)))
        cells &= F.col("cell_lon").isin(wanted)
        inside &= F.pmod(F.col("lon") - lon[0], F.lit(360.0)) <= wide
    return rows.where(cells & inside).drop(*CELLS)
