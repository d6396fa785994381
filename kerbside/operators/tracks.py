"""Track analytics in relational stages: segments, region flags, line crossings, displacement, stops, best photos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions import geometry as G
from kerbside.operators.ranges import running

#: Entries, not frames, over which displacement is measured; pixels below which a vehicle is slow.
ENTRIES, SLOW_PX = 30, 15.0
KEYS = ("channel_id", "track_id")


def with_roi(det: DataFrame, polygon: list[tuple[float, float]] | None) -> DataFrame:
    """Adds ``in_roi``; without a polygon every point counts as inside."""
    inside = G.point_in_polygon(F.col("cx"), F.col("cy"), polygon) if polygon else F.lit(True)
    return det.withColumn("in_roi", inside)


def of_classes(det: DataFrame, classes: list[str]) -> DataFrame:
    """Detections of these classes alone."""
    return det.where(F.col("class_name").isin(classes))


def dispatched(frames: DataFrame, sources: DataFrame) -> DataFrame:
    """Frames of a batch by the channel of their ``source_id``; those of unknown sources go. A row for each source."""
    return frames.join(sources, "source_id").drop("source_id")


def above_thresholds(det: DataFrame, settings: DataFrame, least: float = 0.25) -> DataFrame:
    """Detections above the ``threshold`` of their channel, ``least`` where it has none. A row for each channel."""
    return det.join(settings, "channel_id", "left").where(F.col("confidence") > F.coalesce("threshold", F.lit(least))).drop("threshold")


def with_segments(det: DataFrame) -> DataFrame:
    """Adds ``seg_id``: a track that misses a frame starts anew."""
    own = Window.partitionBy(*KEYS).orderBy("frame", "det_ord")
    last = F.lag("frame").over(own)
    fresh = F.when(last.isNull() | (F.col("frame") - last > 1), 1).otherwise(0)
    number = F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0))
    return det.withColumn("_new", fresh).withColumn("seg_id", (F.col("track_id") * 1000 + number).cast("long")).drop("_new")


def segments(det: DataFrame) -> DataFrame:
    """One row for each segment: where it starts and ends, and its velocity at the end."""
    own = Window.partitionBy(*KEYS, "seg_id").orderBy("frame", "det_ord")
    steps = det.select("*", *[F.lag(c).over(own).alias(f"p_{c}") for c in ("frame", "cx", "cy")])
    end = F.struct("frame", "det_ord")
    at_end = lambda c: F.max_by(c, end)
    return steps.groupBy(*KEYS, "seg_id").agg(
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.min_by("det_ord", end).alias("first_ord"),
        F.min_by("cx", end).alias("first_cx"), F.min_by("cy", end).alias("first_cy"),
        at_end("cx").alias("last_cx"), at_end("cy").alias("last_cy"), at_end("p_frame").alias("before_frame"),
        at_end("p_cx").alias("before_cx"), at_end("p_cy").alias("before_cy"), at_end("in_roi").alias("roi_at_end"),
        F.min_by("class_name", end).alias("class_name"), F.count(F.lit(1)).alias("n_rows"),
    )


def steps(det: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rows with the centroid before them in the same segment."""
    own = Window.partitionBy(*keys, "seg_id").orderBy("frame", "det_ord")
    return det.select("*", F.lag("cx").over(own).alias("prev_cx"), F.lag("cy").over(own).alias("prev_cy"))


def crossings(det: DataFrame, arms: DataFrame, strict: bool = False) -> DataFrame:
    """Crossings of the arms' lines, evaluated where the current point is in the region.

    Lines are infinite, as the original has it; ``strict`` asks that the step meets the segment itself. The arms of
    a site are a handful of rows, which the caller limits to one site; they are broadcast."""
    moves = steps(det).where("prev_cx is not null and in_roi")
    joined = moves.crossJoin(F.broadcast(arms))
    line = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    before = G.side_of_line(*line, F.col("prev_cx"), F.col("prev_cy"))
    after = G.side_of_line(*line, F.col("cx"), F.col("cy"))
    found = joined.withColumn("direction", G.crossing_direction(before, after)).where("direction is not null")
    if strict:
        path = [F.col(c) for c in ("prev_cx", "prev_cy", "cx", "cy")]
        found = found.where(G.side_of_line(*path, line[0], line[1]) * G.side_of_line(*path, line[2], line[3]) <= 0)
    kind = G.crossing_kind(F.col("junction_side"), F.col("direction"))
    return found.select(*KEYS, "seg_id", "frame", "arm_id", "arm_ord", "direction", kind.alias("kind"))


def with_displacement(det: DataFrame, keys: tuple[str, ...] = KEYS, entries: int = ENTRIES) -> DataFrame:
    """Adds ``displacement`` over the last ``entries`` rows of ``keys``; null while there are fewer."""
    own = Window.partitionBy(*keys).orderBy("frame", "det_ord")
    x, y = F.lag("cx", entries - 1).over(own), F.lag("cy", entries - 1).over(own)
    return det.withColumn("displacement", G.distance(x.cast("double"), y.cast("double"), F.col("cx"), F.col("cy")))


def stop_runs(det: DataFrame, slow_px: float = SLOW_PX) -> DataFrame:
    """Runs of slow rows: only rows in the region and not the first of a segment are looked at."""
    looked = steps(with_displacement(det)).where("in_roi and prev_cx is not null and displacement is not null")
    own = Window.partitionBy(*KEYS).orderBy("frame", "det_ord")
    runs = looked.withColumn("moving", F.when(F.col("displacement") < slow_px, 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("moving").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.where("moving = 0").groupBy(*KEYS, "run").agg(
        F.min("frame").alias("stopped_since"), F.max("frame").alias("slow_until"), F.count(F.lit(1)).alias("n_rows")
    )


def stagnations(det: DataFrame, frames: int, slow_px: float = SLOW_PX) -> DataFrame:
    """Stops of ``frames`` at least, and the row at which each becomes stagnant."""
    looked = steps(with_displacement(det)).where("in_roi and prev_cx is not null and displacement is not null")
    own = Window.partitionBy(*KEYS).orderBy("frame", "det_ord")
    runs = looked.withColumn("moving", F.when(F.col("displacement") < slow_px, 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("moving").over(own.rowsBetween(Window.unboundedPreceding, 0))).where("moving = 0")
    since = F.min("frame").over(Window.partitionBy(*KEYS, "run"))
    late = runs.withColumn("stopped_since", since).where(F.col("frame") - F.col("stopped_since") >= frames)
    return late.groupBy(*KEYS, "run").agg(F.min("stopped_since").alias("stopped_since"), F.min("frame").alias("frame")).drop("run")


def best_photo(det: DataFrame) -> DataFrame:
    """The box of largest area times confidence of each track in the region; the earliest of equal ones."""
    score = F.col("w") * F.col("h") * F.col("confidence")
    rank = F.struct(score.alias("score"), (-F.col("frame")).alias("f"), (-F.col("det_ord")).alias("d"))
    best = F.max_by(F.struct("frame", "x", "y", "w", "h", score.alias("score")), rank)
    return det.where("in_roi").groupBy(*KEYS).agg(best.alias("b")).select(*KEYS, "b.*")


def lifetimes(det: DataFrame) -> DataFrame:
    return det.groupBy(*KEYS).agg(
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"),
        (F.max("frame") - F.min("frame") + 1).alias("lifetime"), F.count(F.lit(1)).alias("n_rows"),
        G.rounded(F.avg("confidence"), 2).alias("avg_confidence"), F.max("confidence").alias("max_confidence"),
    )


def duration_ms(first_pts: Column, last_pts: Column, frames: Column, rows: Column, fps: float = 30.0) -> Column:
    """By the clock of the video if two rows have it in order, else by the number of frames."""
    return F.when((rows >= 2) & (last_pts > first_pts), last_pts - first_pts).otherwise((frames / fps * 1000).cast("long"))


def sequential_ids(det: DataFrame) -> DataFrame:
    """Tracks of a channel numbered in the order in which they are first seen."""
    first = det.groupBy(*KEYS).agg(F.min(F.struct("frame", "det_ord")).alias("first"))
    return first.select(*KEYS, F.dense_rank().over(Window.partitionBy("channel_id").orderBy("first")).alias("seq_id"))


def jumps(det: DataFrame, pixels: float) -> DataFrame:
    """How often a track moves further than ``pixels`` from one row to the next."""
    far = G.distance(F.col("prev_cx").cast("double"), F.col("prev_cy").cast("double"), F.col("cx"), F.col("cy")) > pixels
    return steps(det).groupBy(*KEYS).agg(F.count_if(far).alias("n_jumps"))


def progress(det: DataFrame, every: int = 100) -> DataFrame:
    """At every so many frames of a channel: its boxes and tracks, and the frames and boxes so far, and boxes a frame."""
    frames = det.groupBy("channel_id", "frame").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("track_id").alias("tracks"))
    so_far = running(frames, ["channel_id"], ["frame"], {"frames": F.lit(1).cast("long"), "total": F.col("n")})
    mean = G.rounded(F.col("total") / F.col("frames"), 1)
    return so_far.where(F.col("frames") % every == 0).select("channel_id", "frame", "frames", "n", "tracks", "total", mean.alias("mean"))
