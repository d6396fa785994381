"""Where a vehicle came from and went: the direction state machine and arm inference.

The machine is a table of transitions over crossings, stops and losses. Everything that needs only the row and its
neighbours (crossings, region, displacement) is computed before, by windows. The rows then lie side by side by vehicle,
and a task walks through them once with one machine and the last HISTORY points."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside import schemas
from kerbside.functions import geometry as G
from kerbside.operators import stitch, tracks

UNKNOWN, TRANSIT, WAITING, STAGNANT, DONE = "unknown", "in_transit", "waiting", "stagnant", "completed"
#: Rows of history that inference sees; frames a second; seconds until a stop is a stagnation.
HISTORY, FPS, STAGNANT_SECONDS = 300, 30.0, 150.0
JUMP_PX, TURN_DEGREES, LEAST_HEADING = 80.0, 60.0, 5.0

Point = tuple[float, float]
Arm = tuple[str, float, float, float, float]


class Direction:
    """The state of one vehicle. Methods return what an event gives rise to, or None."""

    __slots__ = ("before_stop", "entry", "exit", "state", "stopped_since", "was_stagnant")

    def __init__(self) -> None:
        self.state, self.entry, self.exit = UNKNOWN, None, None
        self.stopped_since, self.before_stop, self.was_stagnant = None, UNKNOWN, False

    def enter(self, arm: str) -> None:
        if self.state in (UNKNOWN, WAITING, STAGNANT):
            self.state, self.entry = TRANSIT, arm

    def leave(self, arm: str, infer_entry) -> tuple[str | None, str, str] | None:
        """(entry, exit, method) of a transit."""
        if self.state == DONE:
            return None
        if self.state == UNKNOWN:
            self.exit = arm
            came = infer_entry()
            if came is None or came == arm:
                return None
            self.entry, self.state = came, DONE
            return came, arm, "inferred"
        if arm == self.entry:  # turned back
            self.state, self.entry = UNKNOWN, None
            return None
        self.exit, self.state = arm, DONE
        return self.entry, arm, "confirmed"

    def lose(self, infer_entry, infer_exit) -> tuple[str | None, str, str] | None:
        if self.state == DONE:
            return None
        came = infer_entry() if self.state == UNKNOWN else self.entry
        went = infer_exit()
        if went is None or went == came or (self.state == UNKNOWN and came is None):
            return None
        return came, went, "inferred"

    def look(self, slow: bool, frame: int, limit: int) -> bool:
        """Is this row the one at which a stop becomes stagnant?"""
        if slow:
            if self.state not in (WAITING, STAGNANT):
                self.before_stop, self.state = self.state, WAITING
            if self.stopped_since is None:
                self.stopped_since = frame
            if self.state != STAGNANT and frame - self.stopped_since >= limit:
                self.state = STAGNANT
                self.was_stagnant = True
                return True
        elif self.state in (WAITING, STAGNANT):
            self.state = TRANSIT if self.entry is not None else self.before_stop
            self.stopped_since = None
        return False


def _span(points: Sequence[Point]) -> Point:
    return points[-1][0] - points[0][0], points[-1][1] - points[0][1]


def _mean(points: Sequence[Point]) -> Point:
    return sum(p[0] for p in points) / len(points), sum(p[1] for p in points) / len(points)


def without_jumps(points: list[Point], pixels: float = JUMP_PX) -> list[Point]:
    """What lies between the first and the last jump, if that is four points; identity switches sit at such jumps."""
    at = [i for i in range(1, len(points)) if math.dist(points[i - 1], points[i]) > pixels]
    kept = points[at[0] : at[-1]] if at else points
    return kept if len(kept) >= 4 else points


def _ray(origin: Point, heading: Point, arm: Arm) -> float | None:
    _, x1, y1, x2, y2 = arm
    (ox, oy), (hx, hy), sx, sy = origin, heading, x2 - x1, y2 - y1
    across = hx * sy - hy * sx
    if abs(across) < 1e-12:
        return None
    t, u = ((x1 - ox) * sy - (y1 - oy) * sx) / across, ((x1 - ox) * hy - (y1 - oy) * hx) / across
    return t if t >= 0 and 0 <= u <= 1 else None


def _apart(point: Point, arm: Arm) -> float:
    _, x1, y1, x2, y2 = arm
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    along = 0.0 if square < 1e-12 else max(0.0, min(1.0, ((point[0] - x1) * dx + (point[1] - y1) * dy) / square))
    return math.dist(point, (x1 + along * dx, y1 + along * dy))


def nearest_arm(points: list[Point], arms: Sequence[Arm], start: bool) -> str | None:
    """The arm a path comes from (``start``) or goes to: the first that the ray along its end meets, else the closest.

    An end whose heading turns away from the middle half of the path by more than TURN_DEGREES is taken as a switch
    of identities; leaving vehicles are then followed along the heading of the middle."""
    if len(points) < 4 or not arms:
        return None
    points = without_jumps(points)
    n, low, high = min(5, len(points) // 2), len(points) // 4, 3 * len(points) // 4
    part = points[:n] if start else points[-n:]
    anchor, heading = _mean(part), _span(part)
    if start:
        heading = (-heading[0], -heading[1])
    else:
        steady = _span(points[low : high + 1])
        long = math.hypot(*heading), math.hypot(*steady)
        if min(long) >= 1e-9:
            cosine = (heading[0] * steady[0] + heading[1] * steady[1]) / (long[0] * long[1])
            if math.degrees(math.acos(max(-1.0, min(1.0, cosine)))) > TURN_DEGREES:
                heading, clean = steady, points[high - n : high]
                anchor = _mean(clean) if len(clean) >= 2 else anchor
    if math.hypot(*heading) > LEAST_HEADING:
        met = [(t, k) for k, a in enumerate(arms) if (t := _ray(anchor, heading, a)) is not None]
        if met:
            return arms[min(met)[1]][0]
    return arms[min((_apart(anchor, a), k) for k, a in enumerate(arms))[1]][0]


def arms_of_paths(paths: DataFrame, arms: Sequence[Arm]) -> DataFrame:
    """Adds ``entry_arm`` and ``exit_arm`` to rows with ``path``, an array of points (x, y) of which the last HISTORY count."""
    own = paths.withColumn("path", F.slice("path", F.greatest(F.size("path") - HISTORY + 1, F.lit(1)), HISTORY))
    kept = [c for c in own.columns if c != "path"]
    schema = ", ".join([f"`{c}` {own.schema[c].dataType.simpleString()}" for c in kept] + ["entry_arm string", "exit_arm string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = [[(p["x"], p["y"]) for p in path] for path in b.column("path").to_pylist()]
            found = [pa.array([nearest_arm(p, arms, start) for p in points], pa.string()) for start in (True, False)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *found], [*kept, "entry_arm", "exit_arm"])

    return own.mapInArrow(run, schema)


def lineage_events(det: DataFrame, arms: DataFrame, fates: DataFrame) -> DataFrame:
    """Rows of ``det`` (with ``in_roi`` and ``seg_id``) with their lineage, the crossings of each in the order of the
    arms, and whether the vehicle is slow; null where that is not looked at."""
    rows = det.join(fates.select("channel_id", "seg_id", "lineage_id", "final_frame", "lost_frame"), ["channel_id", "seg_id"])
    rows = tracks.with_displacement(tracks.steps(rows), ("channel_id", "lineage_id"))
    looked = F.col("in_roi") & F.col("prev_cx").isNotNull()
    # a handful of arms as one literal array: no join, and arms stay in their order
    literal = F.array(*[
        F.struct(F.lit(a.arm_id).alias("arm"), F.lit(a.junction_side).alias("side"), *[F.lit(float(a[c])).alias(c) for c in ("x1", "y1", "x2", "y2")])
        for a in arms.orderBy("arm_ord").collect()
    ])

    def cross(a):
        line = [a[c] for c in ("x1", "y1", "x2", "y2")]
        before = G.side_of_line(*line, F.col("prev_cx"), F.col("prev_cy"))
        way = G.crossing_direction(before, G.side_of_line(*line, F.col("cx"), F.col("cy")))
        return F.when(way.isNotNull(), F.concat_ws(":", G.crossing_kind(a["side"], way), a["arm"]))

    hits = F.when(looked, F.array_compact(F.transform(literal, cross)))
    return rows.select(
        "channel_id", "lineage_id", "seg_id", "track_id", "class_name", "frame", "det_ord", "pts_ms", "cx", "cy", "final_frame", hits.alias("hits"),
        F.when(looked & F.col("displacement").isNotNull(), F.col("displacement") < tracks.SLOW_PX).alias("slow"),
    )


ROW = (
    "channel_id", "lineage_id", "track_id", "class_name", "frame", "det_ord", "pts_ms", "cx", "cy", "final_frame", "hits", "slow",
)


class Vehicle:
    """One lineage: its machine, and what alerts say of it."""

    def __init__(self, first: dict, arms: Sequence[Arm], limit: int) -> None:
        self.first, self.last, self.arms, self.limit = first, first, arms, limit
        self.machine, self.path = Direction(), deque(maxlen=HISTORY)

    def _arm(self, start: bool) -> str | None:
        return nearest_arm(list(self.path), self.arms, start)

    def _alert(self, kind: str, transit: tuple | None = None, frame: int | None = None) -> dict:
        r, machine, (came, went, how) = self.last, self.machine, transit or (None, None, None)
        frame = r["frame"] if frame is None else frame
        still = frame - machine.stopped_since if kind == "stagnant" else None
        return {
            "channel_id": r["channel_id"], "lineage_id": r["lineage_id"], "track_id": str(r["track_id"]), "type": kind, "class_name": r["class_name"],
            "entry_arm": came, "exit_arm": went, "method": how, "was_stagnant": machine.was_stagnant, "frame": frame,
            "first_seen_frame": self.first["frame"], "last_seen_frame": frame, "duration_ms": r["pts_ms"] - self.first["pts_ms"],
            "stationary_ms": None if still is None else int(still / FPS * 1000), "x": r["cx"], "y": r["cy"],
        }

    def see(self, row: dict) -> Iterator[dict]:
        self.last = row
        self.path.append((float(row["cx"]), float(row["cy"])))
        for hit in row["hits"] or ():
            kind, arm = hit.split(":", 1)
            if kind == "entry":
                self.machine.enter(arm)
            elif found := self.machine.leave(arm, lambda: self._arm(True)):
                yield self._alert("transit", found)
        if row["slow"] is not None and self.machine.look(row["slow"], row["frame"], self.limit):
            yield self._alert("stagnant")

    def end(self) -> Iterator[dict]:
        frame = self.last["final_frame"]
        if frame is not None and (found := self.machine.lose(lambda: self._arm(True), lambda: self._arm(False))):
            yield self._alert("transit", found, frame)


def fold(rows: Iterable[dict], arms: Sequence[Arm], limit: int) -> Iterator[dict]:
    """The alerts of all vehicles whose rows (ROW) come one vehicle after the other, each in order."""
    key = vehicle = None
    for row in rows:
        if (row["channel_id"], row["lineage_id"]) != key:
            if vehicle:
                yield from vehicle.end()
            key, vehicle = (row["channel_id"], row["lineage_id"]), Vehicle(row, arms, limit)
        yield from vehicle.see(row)
    if vehicle:
        yield from vehicle.end()


def alerts(
    det: DataFrame, arms: DataFrame, polygon: list[tuple[float, float]] | None, stagnant_frames: int = int(STAGNANT_SECONDS * FPS)
) -> DataFrame:
    """The alerts of ``followed``, with the fates of its segments stitched here."""
    rows = tracks.with_segments(tracks.with_roi(det, polygon))
    return followed(rows, stitch.stitch(tracks.segments(rows)), arms, stagnant_frames)


def followed(rows: DataFrame, fates: DataFrame, arms: DataFrame, stagnant_frames: int = int(STAGNANT_SECONDS * FPS)) -> DataFrame:
    """Transit and stagnation alerts of all channels. A vehicle that is still there when its channel ends has none on
    loss; neither has one whose last segment ended outside the region or was discarded by the stitcher."""
    events = lineage_events(rows, arms, fates)
    known = [(a.arm_id, a.x1, a.y1, a.x2, a.y2) for a in arms.orderBy("arm_ord").collect()]
    fields = [x.split() for x in schemas.ALERTS.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    shape = pa.schema([(name, types[kind]) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (dict(zip(ROW, r)) for b in batches for r in zip(*(b.column(c).to_pylist() for c in ROW)))
        held = []
        for alert in fold(rows, known, stagnant_frames):
            held.append(alert)
            if len(held) == 5000:
                yield pa.RecordBatch.from_pylist(held, shape)
                held = []
        yield pa.RecordBatch.from_pylist(held, shape)

    keys = ("channel_id", "lineage_id")
    beside = events.select(*ROW).repartition(*keys).sortWithinPartitions(*keys, "frame", "det_ord")
    found = beside.mapInArrow(run, schemas.ALERTS)
    alert_id = F.substring(F.sha2(F.concat_ws(":", "channel_id", "lineage_id", "frame", "type", "exit_arm"), 256), 1, 8)
    return found.withColumn("alert_id", alert_id)
