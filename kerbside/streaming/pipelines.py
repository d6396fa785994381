"""The analytics as Structured Streaming queries: windows with watermarks, deduplication, and a stateful processor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_event_time(rows: DataFrame, at: str, lateness: str) -> DataFrame:
    """Watermarks need a timestamp with a time zone."""
    return rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness)


#: A watermark starts at 0 and what is not after it is late: the clock of a video, which starts at 0 too, is set ahead by so many.
FIRST_MS = 1


def on_clock(rows: DataFrame, lateness: str, at: str = "pts_ms") -> DataFrame:
    """Adds ``at``, a timestamp on the clock of the video, with a watermark."""
    return rows.withColumn("at", F.timestamp_millis(F.col(at) + FIRST_MS)).withWatermark("at", lateness)


def stats(rows: DataFrame, key: str, at: str, value: str, width: str = "1 second", lateness: str = "5 seconds") -> DataFrame:
    timed = with_event_time(rows, at, lateness)
    by = timed.groupBy(key, F.window(at, width).alias("w"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max_by(value, at).alias("last")).select(
        key, F.col("w.start").alias("start"), "n", "mean", "last"
    )


def watchdog(rows: DataFrame, key: str, at: str, silence: str = "2 seconds", lateness: str = "5 seconds") -> DataFrame:
    """A row for each stretch of a source that ended in silence."""
    timed = with_event_time(rows, at, lateness)
    by = timed.groupBy(key, F.session_window(at, silence).alias("w"))
    return by.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_alerts(alerts: DataFrame, at: str, lateness: str = "10 minutes") -> DataFrame:
    return with_event_time(alerts, at, lateness).dropDuplicatesWithinWatermark(["alert_id"])


Arms = list[tuple[str, float, float, float, float, str]]
CROSSINGS = "channel_id long, track_id long, frame long, arm_id string, arm_ord int, direction int, kind string"


class CrossingProcessor(StatefulProcessor):
    """Line crossings of one track: the state is its last point, whatever the length of the stream."""

    def __init__(self, arms: Arms) -> None:
        self.arms = arms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "frame long, cx long, cy long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values(["frame", "det_ord"])
        last = self.last.get() if self.last.exists() else None
        out = []
        for r in part.itertuples():
            # a frame without the track begins it anew
            if last is not None and r.frame - last[0] <= 1 and r.in_roi:
                for k, (arm, x1, y1, x2, y2, side) in enumerate(self.arms):
                    before = (x2 - x1) * (last[2] - y1) - (y2 - y1) * (last[1] - x1)
                    after = (x2 - x1) * (r.cy - y1) - (y2 - y1) * (r.cx - x1)
                    if before * after < 0:
                        way = 1 if before < 0 else -1
                        kind = "entry" if way == (1 if side == "left" else -1) else "exit"
                        out.append((int(key[0]), int(key[1]), int(r.frame), arm, k, way, kind))
            last = (int(r.frame), int(r.cx), int(r.cy))
        self.last.update(last)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in CROSSINGS.split(", ")])

    def close(self) -> None:
        pass


def crossings(det: DataFrame, arms: Arms) -> DataFrame:
    """Crossings of a stream of detections with ``in_roi``; tracks are the keys, so a busy channel is many of them."""
    return det.groupBy("channel_id", "track_id").transformWithStateInPandas(
        statefulProcessor=CrossingProcessor(arms), outputStructType=CROSSINGS, outputMode="Append", timeMode="None"
    )


def fan_out(sinks: dict[str, Callable[[DataFrame], None]]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: one batch, computed once, to several sinks."""

    def write(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            for put in sinks.values():
                put(batch)
        finally:
            batch.unpersist()

    return write


def with_settings(det: DataFrame, settings: Callable[[], DataFrame], sink: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: thresholds by channel are read anew for each batch, so that changes take effect between
    batches; channels without one have 0.25."""

    def write(batch: DataFrame, _: int) -> None:
        both = batch.join(F.broadcast(settings()), "channel_id", "left")
        sink(both.where(F.col("confidence") > F.coalesce("threshold", F.lit(0.25))).drop("threshold"))

    return write
