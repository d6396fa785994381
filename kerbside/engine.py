"""The analytics behind one interface, with two engines that are swapped by name: tables in, tables out, or streams in, streams out."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside import schemas
from kerbside.operators import control, direction, tracker, tracks
from kerbside.streaming import alerts as live_alerts
from kerbside.streaming import control as live_control
from kerbside.streaming import pipelines, tracking

Polygon = list[tuple[float, float]]
#: (arm, x1, y1, x2, y2, junction side), in the order in which arms are tried.
Arms = list[tuple[str, float, float, float, float, str]]


class Engine(Protocol):
    """What both can do. The site is fixed when an engine is made."""

    def tracks(self, boxes: DataFrame) -> DataFrame:
        """``channel_id, frame, box, track_id`` of boxes; a row with a null box is a frame without any."""

    def crossings(self, det: DataFrame) -> DataFrame:
        """``channel_id, track_id, frame, arm_id, arm_ord, direction, kind``."""

    def alerts(self, det: DataFrame) -> DataFrame:
        """Transit and stagnation alerts, as ``schemas.ALERTS`` has them."""

    def phased(self, rows: DataFrame, commands: DataFrame) -> DataFrame:
        """``channel_id, pts_ms, det_ord, phase, epoch, epoch_ms`` of the rows that are processed."""


class _Site:
    def __init__(self, arms: Arms, polygon: Polygon | None = None, stagnant_frames: int = int(direction.STAGNANT_SECONDS * direction.FPS)) -> None:
        self.arms, self.polygon, self.stagnant_frames = arms, polygon, stagnant_frames


class BatchEngine(_Site):
    """Over whole tables: a vehicle that is lost when its channel ends is given up there."""

    def tracks(self, boxes: DataFrame) -> DataFrame:
        return tracker.track(boxes.where("box is not null"), frames=boxes.select("channel_id", "frame"))

    def _arms(self, df: DataFrame) -> DataFrame:
        rows = [("site", a, k, a, *map(float, xy), side) for k, (a, *xy, side) in enumerate(self.arms)]
        return df.sparkSession.createDataFrame(rows, schemas.ARMS)

    def crossings(self, det: DataFrame) -> DataFrame:
        rows = tracks.with_segments(tracks.with_roi(det, self.polygon))
        return tracks.crossings(rows, self._arms(det)).drop("seg_id")

    def alerts(self, det: DataFrame) -> DataFrame:
        return direction.alerts(det, self._arms(det), self.polygon, self.stagnant_frames).drop("alert_id")

    def phased(self, rows: DataFrame, commands: DataFrame) -> DataFrame:
        return control.phased(rows.select("channel_id", "pts_ms", "det_ord"), commands)


class StreamEngine(_Site):
    """Over streams: what a channel will still do is not known, so its vehicles are given up when they are due. ``lateness``: of the watermark
    by which a silent channel's vehicles are."""

    def __init__(self, *site, lateness: str = "1 second", **how) -> None:
        super().__init__(*site, **how)
        self.lateness = lateness

    def tracks(self, boxes: DataFrame) -> DataFrame:
        return tracking.tracks(boxes)

    def crossings(self, det: DataFrame) -> DataFrame:
        return pipelines.crossings(tracks.with_roi(det, self.polygon), self.arms)

    def alerts(self, det: DataFrame) -> DataFrame:
        return live_alerts.alerts(tracks.with_roi(det, self.polygon), self.arms, self.stagnant_frames, self.lateness)

    def phased(self, rows: DataFrame, commands: DataFrame) -> DataFrame:
        found = live_control.phased(rows, commands, self.lateness)
        return found.where(F.col("det_ord").isNotNull()).drop("old_phase")


ENGINES = {"batch": BatchEngine, "stream": StreamEngine}


def engine(name: str, arms: Arms, polygon: Polygon | None = None, **how) -> Engine:
    """The engine of this name for a site."""
    if name not in ENGINES:
        raise ValueError(f"no engine is called {name!r}: one of {sorted(ENGINES)}")
    return ENGINES[name](arms, polygon, **how)
