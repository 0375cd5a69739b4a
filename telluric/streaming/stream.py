"""Scoring of a stream of observations: frame by frame as they come, or by event time with a watermark."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from telluric.operators.field import fitted, without_k
from telluric.operators.scoring import into_scores, zone_weighted
from telluric.sources.store import Store


class LateRows(StreamingQueryListener):
    """Counts the rows that streams drop as too late, by query id, once added by spark.streams.addListener."""

    def __init__(self):
        self.dropped: Counter[str] = Counter()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.dropped[str(event.progress.id)] += sum(x.numRowsDroppedByWatermark for x in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def _scored(batch: DataFrame, poles: DataFrame, points: DataFrame, kept: str | None) -> DataFrame:
    found = fitted(without_k(batch), poles, store=Store(batch.sparkSession, kept) if kept else None).predict(points)
    return zone_weighted(into_scores(found)).select("frame_id", "point_idx", "lat", "lon", "score")


def _write(observations: DataFrame, poles: DataFrame, points: DataFrame, path: str, checkpoint: str, kept: str | None, trigger: dict) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        if not batch.isEmpty():
            _scored(batch, poles, points, kept).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return observations.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def score_frames(observations: DataFrame, poles: DataFrame, points: DataFrame, path: str, checkpoint: str, kept: str | None = None, **trigger) -> StreamingQuery:
    """Fit, predict and score each micro-batch's frames and write them below path, one folder for each batch.

    A batch that is run again after a failure replaces its own folder, so each frame is there once. A frame must
    arrive within one micro-batch; for others see score_events. Below kept, factorisations stay for later batches.
    """
    return _write(observations, poles, points, path, checkpoint, kept, trigger)


def frames_by_time(observations: DataFrame, frame: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """A stream of (frame_id, lat, lon, n, i, j, k): the stations of each frame, whole, once the watermark has passed its end.

    observations: ts (timestamp), lat, lon, i, j, k. A frame is a window of event time and has the seconds of its start as its
    id. State is a row for each open frame and station: how many observations it has and their sums, which is what a fit
    takes. Rows that are more than late behind the latest one may come after their frame is gone; they are dropped and counted
    (LateRows).
    """
    by = F.window("ts", frame)
    sums = observations.withWatermark("ts", late).groupBy(by.alias("w"), "lat", "lon").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in "ijk"))
    return sums.select(F.col("w.start").cast("long").alias("frame_id"), "lat", "lon", "n", "i", "j", "k")


def score_events(
    observations: DataFrame, poles: DataFrame, points: DataFrame, path: str, checkpoint: str, *, frame: str = "1 minute", late: str = "2 minutes", kept: str | None = None, **trigger
) -> StreamingQuery:
    """As score_frames, for observations of frames that arrive over several micro-batches and out of order: each frame is fitted once, when it is whole."""
    return _write(frames_by_time(observations, frame, late), poles, points, path, checkpoint, kept, trigger)
