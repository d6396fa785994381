"""Multi-object tracking: boxes of a channel's frames become tracks.

A track moves with constant velocity under a Kalman filter over centre, width and height. Boxes are assigned in three
stages: confident boxes to tracked and lost tracks, the others to what is still tracked, and what is left to tracks
seen only once. Overlaps count times the box's score. In a frame without boxes, tracked ones move on by their filters. A channel is cut wherever its frames are interrupted for longer than a lost track is remembered, so
that one task's rows are bounded by a stretch of uninterrupted video."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRACKS = "channel_id long, frame long, box long, track_id long"
#: Standard deviations of position and velocity, as parts of width and height.
POSITION, VELOCITY = 1 / 20, 1 / 160


@dataclass
class Settings:
    high: float = 0.25
    low: float = 0.1
    new: float = 0.25
    match: float = 0.8
    second: float = 0.5
    unconfirmed: float = 0.7
    buffer: int = 150


def assign(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """One-to-one pairs of least total cost, none above ``limit``. Rows and columns that no possible pair connects do not
    bear on each other: each such group, mostly one track and one box, is solved alone."""
    possible = cost <= limit
    left, out = set(np.flatnonzero(possible.any(1)).tolist()) if cost.size else set(), []
    while left:
        rows, cols = np.array([min(left)]), np.zeros(0, int)
        while True:
            cols = np.flatnonzero(possible[rows].any(0))
            more = np.flatnonzero(possible[:, cols].any(1))
            if len(more) == len(rows):
                break
            rows = more
        left -= set(rows.tolist())
        out += [(int(rows[i]), int(cols[j])) for i, j in _assign(cost[np.ix_(rows, cols)], limit)]
    return out


def _assign(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """The same for one group, by shortest augmenting paths. A pair above the limit counts as the limit, so that leaving
    both out is never dearer."""
    rows, cols = cost.shape
    if rows == cols == 1:
        return [(0, 0)]
    n = rows + cols
    full = np.full((n, n), limit / 2)
    full[:rows, :cols] = np.where(cost <= limit, cost, 1e6)
    full[rows:, cols:] = 0.0
    u, v, owner = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, back, done = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while owner[j0]:
            done[j0] = True
            row = owner[j0]
            now = np.concatenate([[np.inf], full[row - 1] - u[row] - v[1:]])
            better = ~done & (now < least)
            least[better], back[better] = now[better], j0
            j1 = int(np.argmin(np.where(done, np.inf, least)))
            step = least[j1]
            u[owner[done]] += step
            v[done] -= step
            least[~done] -= step
            j0 = j1
        while j0:
            owner[j0], j0 = owner[back[j0]], back[j0]
    return [(int(owner[j]) - 1, j - 1) for j in range(1, cols + 1) if 0 < owner[j] <= rows and cost[owner[j] - 1, j - 1] <= limit]


def iou_cost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not len(a) or not len(b):
        return np.ones((len(a), len(b)))
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    both = np.clip(high - low, 0, None).prod(2)
    area = lambda x: (x[:, 2:] - x[:, :2]).prod(1)
    return 1 - both / (area(a)[:, None] + area(b)[None] - both + 1e-7)


@dataclass
class Track:
    number: int
    mean: np.ndarray
    spread: np.ndarray
    start: int
    seen: int
    confirmed: bool
    lost: bool = False
    box: int = field(default=-1)

    def predict(self) -> None:
        if self.lost:  # its size stays
            self.mean[6:] = 0
        sd = _deviation(self.mean, POSITION, VELOCITY)
        step = np.eye(8)
        step[:4, 4:] = np.eye(4)
        self.mean = step @ self.mean
        self.spread = step @ self.spread @ step.T + np.diag(sd**2)

    def update(self, measured: np.ndarray, frame: int, box: int) -> None:
        noise = np.diag(_deviation(self.mean, POSITION, 0)[:4] ** 2)
        gain = self.spread[:, :4] @ np.linalg.inv(self.spread[:4, :4] + noise)
        self.mean = self.mean + gain @ (measured - self.mean[:4])
        self.spread = self.spread - gain @ self.spread[:4]
        self.seen, self.lost, self.confirmed, self.box = frame, False, True, box

    def corners(self) -> np.ndarray:
        centre, half = self.mean[:2], self.mean[2:4] / 2
        return np.concatenate([centre - half, centre + half])


def _deviation(mean: np.ndarray, position: float, velocity: float) -> np.ndarray:
    size = np.tile(mean[2:4], 4)
    return size * np.repeat([position, velocity], 4)


def measured(corners: np.ndarray) -> np.ndarray:
    return np.concatenate([(corners[:2] + corners[2:]) / 2, corners[2:] - corners[:2]])


class Tracker:
    """All tracks of a channel. ``frame`` takes one frame's boxes and returns the numbers of those that are tracks.

    In a frame without boxes, what is tracked moves on by its filter, and nothing gets older: no track is lost for it."""

    def __init__(self, settings: Settings, first: int = 1) -> None:
        self.settings, self.number, self.clock = settings, first, 0
        self.tracks: list[Track] = []

    def _place(self, m: np.ndarray, box: int) -> Track:
        sd = _deviation(m, 2 * POSITION, 10 * VELOCITY)
        self.number += 1
        return Track(self.number - 1, np.concatenate([m, np.zeros(4)]), np.diag(sd**2), self.clock, self.clock, self.clock == 1, box=box)

    def frame(self, boxes: np.ndarray, corners: np.ndarray, scores: np.ndarray) -> list[tuple[int, int]]:
        """(box, track) of one frame."""
        s = self.settings
        if not len(boxes):
            for t in self.tracks:
                if not t.lost:
                    t.predict()
            return []
        self.clock += 1
        clock, tracks = self.clock, self.tracks
        for t in tracks:
            if t.confirmed:
                t.predict()

        def stage(own: list[Track], at: list[int], limit: float):
            cost = iou_cost(np.array([t.corners() for t in own]).reshape(-1, 4), corners[at])
            if len(at):
                cost = 1 - (1 - cost) * scores[at][None]
            pairs = assign(cost, limit)
            for i, j in pairs:
                own[i].update(measured(corners[at[j]]), clock, int(boxes[at[j]]))
            hit, used = {i for i, _ in pairs}, {j for _, j in pairs}
            return [t for i, t in enumerate(own) if i not in hit], [b for j, b in enumerate(at) if j not in used]

        strong = [k for k in range(len(boxes)) if scores[k] >= s.high]
        weak = [k for k in range(len(boxes)) if s.low < scores[k] < s.high]
        rest, free = stage([t for t in tracks if t.confirmed], strong, s.match)
        rest, _ = stage([t for t in rest if not t.lost], weak, s.second)
        for t in rest:
            t.lost = True
        gone, free = stage([t for t in tracks if not t.confirmed], free, s.unconfirmed)
        tracks = [t for t in tracks if t not in gone and not (t.lost and clock - t.seen > s.buffer)]
        tracks += [self._place(measured(corners[k]), int(boxes[k])) for k in free if scores[k] >= s.new]
        # of two tracks in one place, one of them lost, the longer-lived stays
        now, lost = [t for t in tracks if not t.lost], [t for t in tracks if t.lost]
        twice = np.argwhere(iou_cost(np.array([t.corners() for t in now]).reshape(-1, 4), np.array([t.corners() for t in lost]).reshape(-1, 4)) < 0.15)
        drop = {id(lost[j] if now[i].seen - now[i].start > lost[j].seen - lost[j].start else now[i]) for i, j in twice}
        self.tracks = [t for t in tracks if id(t) not in drop]
        return [(t.box, t.number) for t in self.tracks if not t.lost and t.confirmed and t.seen == clock]


def follow(frames: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], s: Settings, first: int = 1) -> list[tuple[int, int, int]]:
    """(frame, box, track) of frames given as (frame, box numbers, corners, scores), with or without boxes."""
    tracker = Tracker(s, first)
    return [(frame, *found) for frame, *boxes in frames for found in tracker.frame(*boxes)]


def frames_of(part: pd.DataFrame) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The frames of rows ``frame, box, x1, y1, x2, y2, score`` in order; a row without ``box`` says that its frame was there."""
    part = part.sort_values(["frame", "box"])
    out = []
    for frame, g in part.groupby("frame"):
        g = g[g["box"].notna()]
        out.append((int(frame), g["box"].to_numpy().astype(np.int64), g[["x1", "y1", "x2", "y2"]].to_numpy(float), g["score"].to_numpy(float)))
    return out


def clock(boxes: DataFrame) -> DataFrame:
    """``channel_id, frame``: every frame from the first to the last of each channel."""
    ends = boxes.groupBy("channel_id").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    return ends.select("channel_id", F.explode(F.sequence("a", "b")).alias("frame"))


def track(boxes: DataFrame, settings: Settings | None = None, frames: DataFrame | None = None) -> DataFrame:
    """``channel_id, frame, box, track_id`` from ``channel_id, frame, box, x1, y1, x2, y2, score``.

    ``frames``: the frames that there were, ``channel_id, frame``, without which a frame without boxes isn't known. Numbers are
    unique in a channel: those of a stretch start at its first frame times a million."""
    s = settings or Settings()
    order = Window.partitionBy("channel_id").orderBy("frame")
    seen = boxes.select("channel_id", "frame")
    every = (seen.unionByName(frames.select("channel_id", "frame")) if frames is not None else seen).distinct()
    fresh = F.when(F.col("frame") - F.lag("frame").over(order) > s.buffer, 1).otherwise(0)
    every = every.withColumn("_new", fresh)
    every = every.select("channel_id", "frame", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("stretch"))
    names = [x.split()[0] for x in TRACKS.split(", ")]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = frames_of(part)
        found = follow(rows, s, rows[0][0] * 1_000_000 + 1)
        return pd.DataFrame([(int(part["channel_id"].iloc[0]), *r) for r in found], columns=names)

    both = every.join(boxes, ["channel_id", "frame"], "left")
    return both.groupBy("channel_id", "stretch").applyInPandas(run, TRACKS)
