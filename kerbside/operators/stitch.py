"""Stitching of fragmented tracks.

Only the ends of segments matter, a few rows for each vehicle. The greedy matching depends on order, but not for long: what
is lost is forgotten after ``MAX_AGE`` frames. So a channel is cut into slices of time, which are matched side by side, each from
nothing; then every slice that began with other lost tracks than its predecessor ended with is matched again from those,
until no slice did. The result is that of one walk through the whole channel."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.storage import discard, materialize

#: Frames for which a lost track can be found again; pixels from its predicted place; frames that are predicted at most.
MAX_AGE, MAX_PX, MAX_PREDICTED = 60, 100.0, 15
#: Frames of a slice, about five minutes of video.
SLICE = 9_000

_PLACE = ("seg_id", "track_id", "last_frame", "last_cx", "last_cy", "before_frame", "before_cx", "before_cy")
FACTS = "channel_id long, slice long, seg_id long, prev_seg long, root long, distance double, gap_frames long, lost_frame long, final_frame long, entered string, state string"


class Matching:
    """The lost tracks of a channel, from the frame ``begin`` on.

    ``state``: what an earlier slice ended with. A lost track that comes of age in a frame in which a new one appears is
    discarded, not finalised. A track that is lost again takes the place of its own earlier entry."""

    def __init__(self, state: str | None, max_age: int, max_px: float) -> None:
        self.max_age, self.max_px = max_age, max_px
        held = json.loads(state) if state else {"lost": [], "before": []}
        self.lost: dict[int, dict] = {e["track_id"]: e for e in held["lost"]}
        #: Segments of one row that go on from the last point of a lost one, until they are lost themselves.
        self.before: dict[int, list] = {s: b for s, *b in held["before"]}
        self.leaving: list[dict] = []
        self.gone = 0
        #: The first segment, as far as this slice knows, of each that was matched in it.
        self.root: dict[int, int] = {}

    def state(self) -> str:
        left = {r["seg_id"] for r in self.leaving[: self.gone]}
        return json.dumps({"lost": list(self.lost.values()), "before": sorted([s, *b] for s, b in self.before.items() if s not in left)})

    def advance(self, frame: int) -> Iterator[dict]:
        """What happens before ``frame``: expiry, then losses, frame by frame."""
        while True:
            due = min((e["lost_frame"] + self.max_age + 1 for e in self.lost.values()), default=math.inf)
            leave = self.leaving[self.gone]["last_frame"] + 1 if self.gone < len(self.leaving) else math.inf
            if min(due, leave) >= frame:
                return
            if due <= leave:
                for track in [t for t, e in self.lost.items() if e["lost_frame"] + self.max_age + 1 <= due]:
                    yield {"seg_id": self.lost.pop(track)["seg_id"], "final_frame": due}
            else:
                r, self.gone = self.leaving[self.gone], self.gone + 1
                if r["roi_at_end"]:
                    entry = {c: r[c] for c in _PLACE}
                    if r["seg_id"] in self.before:
                        entry.update(zip(("before_frame", "before_cx", "before_cy"), self.before[r["seg_id"]]))
                    self.lost[r["track_id"]] = {**entry, "lost_frame": leave}
                    yield {"seg_id": r["seg_id"], "lost_frame": leave}

    def begin(self, r: dict) -> Iterator[dict]:
        """A new segment: the lost track whose predicted place is nearest, the first one of equally near ones."""
        now = r["first_frame"]
        for track in [t for t, e in self.lost.items() if now - e["lost_frame"] > self.max_age]:
            del self.lost[track]
        best, near = None, self.max_px
        for track, e in self.lost.items():
            ahead, step = min(now - e["lost_frame"], MAX_PREDICTED), e["last_frame"] - (e["before_frame"] if e["before_frame"] is not None else e["last_frame"])
            x, y = e["last_cx"], e["last_cy"]
            if step > 0:
                x += (e["last_cx"] - e["before_cx"]) / step * ahead
                y += (e["last_cy"] - e["before_cy"]) / step * ahead
            far = math.hypot(r["first_cx"] - x, r["first_cy"] - y)
            if far < near or (best is None and far == near):
                best, near = track, far
        if best is not None:
            e = self.lost.pop(best)
            self.root[r["seg_id"]] = self.root.get(e["seg_id"], e["seg_id"])
            yield {"seg_id": r["seg_id"], "prev_seg": e["seg_id"], "root": self.root[r["seg_id"]], "distance": near, "gap_frames": now - e["lost_frame"]}
            if r["before_frame"] is None:
                self.before[r["seg_id"]] = [e["last_frame"], e["last_cx"], e["last_cy"]]


def match(rows: list[dict], state: str | None = None, until: int | None = None, max_age: int = MAX_AGE, max_px: float = MAX_PX) -> tuple[list[dict], str]:
    """Facts about the segments ``rows`` of a slice, and the state it ends with.

    A row says whether its segment ``starts`` and whether it ``leaves`` in the slice. ``until``: the first frame beyond it; None
    for the last slice, after which whatever is still lost is finalised at the channel's end."""
    m = Matching(state, max_age, max_px)
    m.leaving = sorted((r for r in rows if r["leaves"]), key=lambda r: (r["last_frame"], r["first_frame"], r["first_ord"]))
    facts: list[dict] = []
    for r in sorted((r for r in rows if r["starts"]), key=lambda r: (r["first_frame"], r["first_ord"])):
        facts += m.advance(r["first_frame"])
        facts += m.begin(r)
    if until is not None:
        facts += m.advance(until)
    else:
        end = rows[0]["channel_end"] if rows else 0
        facts += m.advance(end + 1)
        facts += [{"seg_id": e["seg_id"], "final_frame": end} for e in m.lost.values()]
    return facts, m.state()


def match_session(rows: list[dict], max_age: int = MAX_AGE, max_px: float = MAX_PX) -> Iterator[dict]:
    """The fate of each segment of a channel that is walked through as a whole, with its lineage."""
    own = [{**r, "starts": True, "leaves": r["last_frame"] < r["channel_end"]} for r in rows]
    fate = {r["seg_id"]: dict.fromkeys(("prev_seg", "distance", "gap_frames", "lost_frame", "final_frame")) for r in rows}
    for f in match(own, None, None, max_age, max_px)[0]:
        fate[f["seg_id"]].update(f)
    root: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r["first_frame"], r["first_ord"])):
        before = fate[r["seg_id"]]["prev_seg"]
        root[r["seg_id"]] = r["seg_id"] if before is None else root[before]
    for r in rows:
        yield {"channel_id": r["channel_id"], "lineage_id": root[r["seg_id"]], **fate[r["seg_id"]], "seg_id": r["seg_id"]}


def sliced(segments: DataFrame, frames: int) -> DataFrame:
    """Each segment in the slice in which it starts and in the one in which it leaves, if it is not there when its channel ends."""
    ends = segments.groupBy(F.col("channel_id").alias("_of")).agg(F.max("last_frame").alias("channel_end"))
    own = segments.select(
        "channel_id", "track_id", "seg_id", "first_frame", "first_ord", "last_frame", "first_cx", "first_cy", "last_cx", "last_cy",
        "before_frame", "before_cx", "before_cy", "roi_at_end",
    ).join(ends, F.col("channel_id") == F.col("_of")).drop("_of")
    at = lambda c: F.floor(c / frames)
    leaves = F.when(F.col("last_frame") < F.col("channel_end"), at(F.col("last_frame") + 1))
    start = at(F.col("first_frame"))
    where = F.array_distinct(F.array_compact(F.array(start, leaves)))
    return own.withColumn("slice", F.explode(where)).withColumns(
        {"starts": F.col("slice") == start, "leaves": F.coalesce(F.col("slice") == leaves, F.lit(False)), "last": F.col("slice") == at(F.col("channel_end"))}
    )


def stitch(segments: DataFrame, max_age: int = MAX_AGE, max_px: float = MAX_PX, frames: int = SLICE) -> DataFrame:
    """``channel_id, seg_id, lineage_id, prev_seg, distance, gap_frames, lost_frame, final_frame`` of every segment.
    A lineage is a chain of stitched segments, named after its first one. ``frames``: those of a slice, more than ``max_age``."""
    if frames <= max_age + 1:
        raise ValueError("a slice must outlast what is lost in it")
    columns = [x.split()[0] for x in FACTS.split(", ")]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = part.astype(object).where(part.notna(), None).to_dict("records")
        first = rows[0]
        entered = first["entered"]
        facts, state = match([r for r in rows if r["seg_id"] is not None], entered, None if first["last"] else (first["slice"] + 1) * frames, max_age, max_px)
        beside = {"channel_id": first["channel_id"], "slice": first["slice"]}
        return pd.DataFrame([{**beside, "entered": entered, "state": state}, *({**beside, **f} for f in facts)], columns=columns, dtype=object)

    rows = materialize(sliced(segments, frames), "segments")
    null = F.lit(None).cast("string")
    # one row for each slice between a channel's first and last, so that what is lost passes through slices without an end
    spans = rows.groupBy("channel_id").agg(F.min("slice").alias("a"), F.max(F.floor(F.col("channel_end") / frames)).alias("b"))
    slices = spans.select("channel_id", F.explode(F.sequence("a", "b")).alias("slice"), "b").select("channel_id", "slice", (F.col("slice") == F.col("b")).alias("is_last"))
    laid = slices.join(rows.drop("last"), ["channel_id", "slice"], "left").withColumnRenamed("is_last", "last")
    # few bytes but much work: with its number given, slices are not gathered in one task for their size
    laid = laid.repartition(int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")), "channel_id", "slice")
    found = materialize(laid.withColumn("entered", null).groupBy("channel_id", "slice").applyInPandas(run, FACTS), "matched")
    several = not spans.where("a < b").isEmpty()
    while several:
        ends = found.where("state is not null").select("channel_id", "slice", "entered", "state")
        before = ends.select("channel_id", (F.col("slice") + 1).alias("slice"), F.col("state").alias("given"))
        nothing = Matching(None, max_age, max_px).state()
        given = F.when(F.col("given") != nothing, F.col("given"))
        wrong = ends.join(before, ["channel_id", "slice"]).where(~F.col("entered").eqNullSafe(given)).select("channel_id", "slice", given.alias("entered"))
        wrong = materialize(wrong, "wrong")
        if wrong.isEmpty():
            break
        again = laid.join(wrong, ["channel_id", "slice"]).groupBy("channel_id", "slice").applyInPandas(run, FACTS)
        kept = found.join(wrong.select("channel_id", "slice"), ["channel_id", "slice"], "left_anti")
        last, found = found, materialize(kept.unionByName(again), "matched")
        discard(last, wrong)
    names = ("prev_seg", "root", "distance", "gap_frames", "lost_frame", "final_frame")
    facts = found.where("seg_id is not null").groupBy("channel_id", "seg_id").agg(*[F.max(c).alias(c) for c in names])
    own = rows.where("starts").select("channel_id", "seg_id").join(facts, ["channel_id", "seg_id"], "left")
    if several:
        roots = lineages(facts.where("root is not null").select("channel_id", "seg_id", "root"))
        own = own.drop("root").join(roots, ["channel_id", "seg_id"], "left")
    return own.select(
        "channel_id", "seg_id", F.coalesce("root", "seg_id").alias("lineage_id"), "prev_seg", "distance", "gap_frames", "lost_frame", "final_frame")


def lineages(links: DataFrame) -> DataFrame:
    """``channel_id, seg_id, root`` of segments that continue another one. ``root`` is the first segment as far as a slice knows; each round
    doubles how far back a segment sees."""
    found = materialize(links, "lineages")
    while True:
        further = found.select("channel_id", F.col("seg_id").alias("root"), F.col("root").alias("further"))
        if found.join(further, ["channel_id", "root"], "left_semi").isEmpty():
            return found
        met = found.join(further, ["channel_id", "root"], "left")
        last, found = found, materialize(met.select("channel_id", "seg_id", F.coalesce("further", "root").alias("root")), "lineages")
        discard(last)
