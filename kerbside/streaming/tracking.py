"""The tracker as a stateful stream: filters and numbers of a channel are carried from batch to batch."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kerbside.operators.tracker import TRACKS, Settings, Tracker, frames_of


class TrackProcessor(StatefulProcessor):
    """One channel: every filter moves in every frame, so its state is written as a whole, a few hundred numbers a track."""

    def __init__(self, settings: Settings) -> None:
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tracker = handle.getValueState("tracker", "last long, body binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = frames_of(pd.concat(list(rows)))
        last, tracker = -1, None
        if self.tracker.exists():
            last, body = self.tracker.get()
            tracker = pickle.loads(bytes(body))
        out = []
        for frame, *boxes in frames:
            if tracker is None or frame - last > self.settings.buffer:  # interrupted: numbers begin anew, as in the batch
                tracker = Tracker(self.settings, frame * 1_000_000 + 1)
            elif frame <= last:
                continue
            last = frame
            out += [(int(key[0]), frame, *found) for found in tracker.frame(*boxes)]
        self.tracker.update((last, pickle.dumps(tracker)))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in TRACKS.split(", ")])

    def close(self) -> None:
        pass


def tracks(boxes: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``channel_id, frame, box, track_id`` of a stream of boxes; a row without ``box`` is a frame without any. Rows of a channel
    must come in the order of their frames, each frame in one batch; rows of frames that are over are dropped."""
    return boxes.groupBy("channel_id").transformWithStateInPandas(
        statefulProcessor=TrackProcessor(settings or Settings()), outputStructType=TRACKS, outputMode="Append", timeMode="None"
    )
