"""The alert pipeline as one stateful stream: tracks of a channel become segments, are stitched, cross arms, stop, get
lost and are given up, frame by frame, with the alerts that the batch form gives.

The state of a channel is two maps by track, of the active ones and of the lost ones, each with the machine and the last
points of its vehicle; a batch writes the tracks that it changed and no others. A camera sees a bounded number of vehicles
at a time, and a lost one is kept for ``MAX_AGE`` frames. Rows of a channel must come in the order of their frames; rows of
frames that are over are dropped. With a watermark, a timer gives up the vehicles of a channel that has fallen silent: frames
that the watermark has passed are over, with rows or without."""

from __future__ import annotations

import math
import pickle
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kerbside import schemas
from kerbside.operators import tracks
from kerbside.operators.direction import FPS, STAGNANT_SECONDS, Vehicle
from kerbside.operators.stitch import MAX_AGE, MAX_PREDICTED, MAX_PX
from kerbside.sources.detections import FRAME_MS
from kerbside.streaming.pipelines import FIRST_MS, on_clock

#: (arm, x1, y1, x2, y2, junction side), in the order in which arms are tried.
Arms = list[tuple[str, float, float, float, float, str]]
#: Frames after which a track that has not been seen again may start its numbers anew.
REMEMBERED = 1_000_000


class Numbers(dict):
    """The last number and frame of each track id."""

    def forget(self, before: int) -> None:
        for track in [t for t, (_, frame) in self.items() if frame <= before]:
            del self[track]


class _Segment:
    """A track as long as no frame misses it. ``points``: its last two, or those of the track that it continues."""

    def __init__(self, seg_id: int, vehicle: Vehicle, recent: deque) -> None:
        self.seg_id, self.vehicle, self.recent = seg_id, vehicle, recent
        self.points: list[tuple[int, int, int]] = []
        self.first: tuple[int, int] | None = None
        self.in_roi, self.rows, self.lost_frame = False, 0, 0


class Channel:
    """All that is known of a channel. ``frame`` takes the rows of one frame, in order; ``end`` closes the channel."""

    def __init__(self, channel_id: int, arms: Arms, limit: int) -> None:
        self.channel_id, self.arms, self.limit = channel_id, arms, limit
        self.plain = [a[:5] for a in arms]
        self.active: dict[int, _Segment] = {}
        self.lost: dict[int, _Segment] = {}
        self.numbers = Numbers()
        self.now = -1

    def _give_up(self, s: _Segment, frame: int) -> Iterator[dict]:
        s.vehicle.last = {**s.vehicle.last, "final_frame": frame}
        yield from s.vehicle.end()

    def _advance(self, frame: int) -> Iterator[dict]:
        """What happens before ``frame``: losses get old and tracks get lost, in the order of time."""
        leaving = sorted(
            ((s.points[-1][0] + 1, *s.first, track) for track, s in self.active.items() if s.points[-1][0] + 1 < frame), reverse=True
        )
        while True:
            due = min((s.lost_frame + MAX_AGE + 1 for s in self.lost.values()), default=math.inf)
            leave = leaving[-1][0] if leaving else math.inf
            if min(due, leave) >= frame:
                return
            if due <= leave:
                for track in [t for t, s in self.lost.items() if s.lost_frame + MAX_AGE + 1 <= due]:
                    yield from self._give_up(self.lost.pop(track), due)
            else:
                track = leaving.pop()[-1]
                s = self.active.pop(track)
                if s.in_roi:
                    s.lost_frame = leave
                    self.lost[track] = s

    def _begin(self, row: dict) -> _Segment:
        frame, track = row["frame"], row["track_id"]
        number = self.numbers.get(track, (0, 0))[0] + 1
        for old in [t for t, s in self.lost.items() if frame - s.lost_frame > MAX_AGE]:
            del self.lost[old]  # comes of age in a frame with a new track: dropped
        best, near = None, MAX_PX
        for old, s in self.lost.items():
            (f1, x, y), ahead = s.points[-1], min(frame - s.lost_frame, MAX_PREDICTED)
            if len(s.points) > 1 and f1 > s.points[0][0]:
                f0, x0, y0 = s.points[0]
                x, y = x + (x - x0) / (f1 - f0) * ahead, y + (y - y0) / (f1 - f0) * ahead
            far = math.hypot(row["cx"] - x, row["cy"] - y)
            if far < near or (best is None and far == near):
                best, near = old, far
        seg_id = track * 1000 + number
        if best is None:
            new = _Segment(seg_id, Vehicle({**row, "lineage_id": seg_id}, self.plain, self.limit), deque(maxlen=tracks.ENTRIES))
        else:
            old = self.lost.pop(best)
            new = _Segment(seg_id, old.vehicle, old.recent)
            new.points = old.points[-1:]
        new.first = (frame, row["det_ord"])
        self.numbers[track] = (number, frame)
        return new

    def _hits(self, before: tuple[int, int, int], row: dict) -> Iterator[str]:
        for arm, x1, y1, x2, y2, side in self.arms:
            was = (x2 - x1) * (before[2] - y1) - (y2 - y1) * (before[1] - x1)
            is_ = (x2 - x1) * (row["cy"] - y1) - (y2 - y1) * (row["cx"] - x1)
            if was * is_ < 0:
                yield ("entry:" if (was < 0) == (side == "left") else "exit:") + arm

    def frame(self, rows: Iterable[dict]) -> Iterator[dict]:
        for row in rows:
            if row["frame"] < self.now:
                continue
            if row["frame"] > self.now:
                yield from self._advance(row["frame"])
                self.now = row["frame"]
            s = self.active.get(row["track_id"])
            if s is None:
                s = self.active[row["track_id"]] = self._begin(row)
            looked = row["in_roi"] and s.rows > 0
            s.recent.append((row["cx"], row["cy"]))
            slow = None
            if looked and len(s.recent) == tracks.ENTRIES:
                slow = math.hypot(row["cx"] - s.recent[0][0], row["cy"] - s.recent[0][1]) < tracks.SLOW_PX
            hits = list(self._hits(s.points[-1], row)) if looked else None
            s.points = [*s.points[-1:], (row["frame"], row["cx"], row["cy"])]
            s.in_roi, s.rows = row["in_roi"], s.rows + 1
            lineage = s.vehicle.first["lineage_id"]
            yield from s.vehicle.see({**row, "lineage_id": lineage, "hits": hits, "slow": slow, "final_frame": None})
        self.numbers.forget(self.now - REMEMBERED)

    def pass_(self, frame: int) -> Iterator[dict]:
        """Frames up to this one are over; those after the last one seen had no rows."""
        if frame > self.now:
            yield from self._advance(frame + 1)
            self.now = frame

    def due(self) -> int | None:
        """The first frame in which something happens even if no row comes."""
        ends = [s.lost_frame + MAX_AGE + 1 for s in self.lost.values()]
        ends += [s.points[-1][0] + MAX_AGE + 2 for s in self.active.values()]
        return min(ends, default=None)

    def end(self) -> Iterator[dict]:
        """What is lost when the channel ends is given up then; what is still there has no alert."""
        yield from self._advance(self.now + 1)
        for s in self.lost.values():
            yield from self._give_up(s, self.now)
        self.lost.clear()


class _StoredNumbers:
    """Numbers in a map state, read and written track by track; old ones are cleared out when the channel is silent."""

    def __init__(self, state) -> None:
        self.state = state

    def get(self, track: int, default: tuple[int, int]) -> tuple[int, int]:
        return tuple(self.state.getValue((track,))) if self.state.containsKey((track,)) else default

    def __setitem__(self, track: int, value: tuple[int, int]) -> None:
        self.state.updateValue((track,), value)

    def forget(self, before: int) -> None:
        pass

    def clear_out(self, before: int) -> None:
        for key in [k for k, (_, frame) in self.state.iterator() if frame <= before]:
            self.state.removeKey(key)


class AlertProcessor(StatefulProcessor):
    """``frame_ms``: milliseconds of a frame, by which the watermark tells which frames are over; None: no timers."""

    def __init__(self, arms: Arms, limit: int, frame_ms: int | None = None) -> None:
        self.arms, self.limit, self.frame_ms = arms, limit, frame_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "now long, timer long")
        self.active = handle.getMapState("active", "track long", "body binary")
        self.lost = handle.getMapState("lost", "track long", "body binary")
        self.numbers = handle.getMapState("numbers", "track long", "number long, frame long")

    def _open(self, channel_id: int) -> tuple[Channel, int | None]:
        channel, timer = Channel(channel_id, self.arms, self.limit), None
        channel.numbers = _StoredNumbers(self.numbers)
        if self.clock.exists():
            channel.now, timer = self.clock.get()
        for of, state in ((channel.active, self.active), (channel.lost, self.lost)):
            of.update((k[0], pickle.loads(bytes(v[0]))) for k, v in state.iterator())
        return channel, timer

    def _close(self, channel: Channel, before: tuple[dict, dict], seen: set[int], timer: int | None) -> None:
        """Writes what changed: tracks with rows, tracks that are new on their side, and those that left it."""
        for state, was, now in ((self.active, before[0], channel.active), (self.lost, before[1], channel.lost)):
            for track in was.keys() - now.keys():
                state.removeKey((track,))
            for track, s in now.items():
                if was.get(track) is not s or (track in seen and now is channel.active):
                    state.updateValue((track,), (pickle.dumps(s),))
        due = channel.due() if self.frame_ms else None
        at = None if due is None else due * self.frame_ms + FIRST_MS
        if at != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if at is not None:
                self.handle.registerTimer(at)
        self.clock.update((channel.now, at))

    @staticmethod
    def _rows(found: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(found, columns=[x.split()[0] for x in schemas.ALERTS.split(", ")])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values(["frame", "det_ord"])
        channel, timer = self._open(int(key[0]))
        before = dict(channel.active), dict(channel.lost)
        names = ("channel_id", "track_id", "class_name", "frame", "det_ord", "pts_ms", "cx", "cy", "in_roi")
        found = list(channel.frame(dict(zip(names, r)) for r in zip(*(part[c].tolist() for c in names))))
        self._close(channel, before, set(part["track_id"].tolist()), timer)
        yield self._rows(found)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        channel, timer = self._open(int(key[0]))
        before = dict(channel.active), dict(channel.lost)
        found = list(channel.pass_((timerValues.getCurrentWatermarkInMs() - FIRST_MS) // self.frame_ms))
        channel.numbers.clear_out(channel.now - REMEMBERED)
        # the timer that rang is gone
        self._close(channel, before, set(), None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer)
        yield self._rows(found)

    def close(self) -> None:
        pass


def alerts(
    det: DataFrame, arms: Arms, stagnant_frames: int = int(STAGNANT_SECONDS * FPS), lateness: str | None = None, frame_ms: int = FRAME_MS
) -> DataFrame:
    """Alerts of a stream of detections with ``in_roi``, as they arise. The channel is the key.

    ``lateness``: of the watermark on the clock of the video (``pts_ms``), which must be one for all channels; with it, the
    vehicles of a channel without further rows are given up when they are due. Without it they wait for its next row."""
    if lateness:
        det = on_clock(det, lateness)
    return det.groupBy("channel_id").transformWithStateInPandas(
        statefulProcessor=AlertProcessor(arms, stagnant_frames, frame_ms if lateness else None), outputStructType=schemas.ALERTS,
        outputMode="Append", timeMode="EventTime" if lateness else "None",
    )
