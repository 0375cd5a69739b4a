"""The calls in their usual order: fit observations, fix the points, predict and score, read merged scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from telluric.operators.grid import geographical_grid
from telluric.operators.field import SCALE, Fitted, fitted, pole_grid, without_k
from telluric.operators.scoring import encoded, into_scores, merged, zone_weighted
from telluric.sources.schemas import POINT_GRID, POLE_ALTITUDE, POLE_GRID
from telluric.sources.store import Store


class NotFitted(RuntimeError):
    """A call that needs an earlier one."""


class Engine:
    """Fitted amplitudes and the latest scores, kept in a Store; observations may hold many frames."""

    def __init__(self, spark: SparkSession, path: str, poles: DataFrame | None = None, points: DataFrame | None = None):
        self.spark, self.state = spark, Store(spark, path)
        self.poles = poles if poles is not None else geographical_grid(spark, *POLE_GRID).withColumnRenamed("idx", "pole_idx")
        self.grid = points if points is not None else geographical_grid(spark, *POINT_GRID).withColumnRenamed("idx", "point_idx")

    def fit_obs(self, observations: DataFrame) -> bool:
        """Fit and store amplitudes from the horizontal components; whether fit_pred is still to be called.

        Factorisations stay in the store: stations that it has met before are not factored again.
        """
        if observations.isEmpty():
            raise NotFitted("no observations to fit")
        found = fitted(without_k(observations), self.poles, store=self.state)
        self.state.store("amplitudes", found.amplitudes())
        self.state.store("frames", found.frames)
        return self.state.load("points") is None

    def fit_pred(self) -> None:
        """Fix the points of prediction."""
        if self.state.load("frames") is None:
            raise NotFitted("fit_obs comes before fit_pred")
        self.state.store("points", self.grid)

    def predict(self, derivative: bool = False) -> DataFrame:
        """The field at the points; its weighted scores replace the stored ones of their kind."""
        frames = self.state.load("frames")
        if frames is None:
            raise NotFitted("fit_obs comes before predict")
        sets = frames.select("set_id").distinct()
        factors = self.state.parts("factors").join(sets, "set_id", "left_semi").dropDuplicates(["set_id"])
        found = Fitted(frames, factors, pole_grid(self.poles), POLE_ALTITUDE, SCALE)
        points = self.state.load("points")
        predictions = self.state.store("predictions", found.predict(points if points is not None else self.grid))
        scored = zone_weighted(into_scores(predictions, derivative)).select("frame_id", "point_idx", "lat", "lon", "score")
        self.state.store("scores_derivative" if derivative else "scores_field", scored)
        return predictions

    def scores(self) -> DataFrame:
        """(frame_id, point_idx, code) by frame and point: codes of the merged scores, those of the field alone if there are no others; no rows without any of the field."""
        field, derivative = self.state.load("scores_field"), self.state.load("scores_derivative")
        keys = ["frame_id", "point_idx"]
        if field is None:
            return self.spark.createDataFrame([], "frame_id long, point_idx long, code int")
        return encoded(field if derivative is None else merged(field, derivative, keys), keys).orderBy(*keys)
