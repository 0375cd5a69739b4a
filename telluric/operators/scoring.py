"""Scores of predictions, their merge and their codes, as DataFrame transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telluric.functions import scores


def into_scores(predictions: DataFrame, derivative: bool = False) -> DataFrame:
    """predictions with score, from the northward component."""
    return predictions.withColumn("score", scores.derivative_score(F.col("i")) if derivative else scores.field_score(F.col("i")))


def zone_weighted(scored: DataFrame, unit: str = "m") -> DataFrame:
    """Scores weighted by the auroral zone."""
    return scored.withColumn("score", scores.zone_score(F.col("lat"), F.col("lon"), F.col("score"), unit))


def merged(field: DataFrame, derivative: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lat, lon, score): the larger score of points that both have; places are those of field."""
    other = derivative.select(*keys, F.col("score").alias("other"))
    return field.join(other, keys).select(*keys, "lat", "lon", scores.larger(F.col("score"), F.col("other")).alias("score"))


def encoded(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code) with flag 0."""
    return scored.select(*keys, scores.encode(F.col("score")).alias("code"))
