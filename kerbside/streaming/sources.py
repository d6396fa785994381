"""Many sources in one stream: frames of several cameras in batches, crops that wait for their pictures, and samples that
are taken once over any number of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kerbside.functions import geometry as G
from kerbside.operators.ranges import running
from kerbside.streaming.pipelines import on_clock

#: Sources of one batch, and how long a batch waits for them.
SOURCES, PUSH_MS = 8, 33


def together(sources: dict[int, DataFrame], at: str = "arrived", lateness: str = "1 second", columns: list[str] | None = None) -> DataFrame:
    """The rows of all sources with their ``source_id``. Each source has a watermark of its own, on the time at which its rows arrived.

    By arrival no row of a source that had stalled is late. What the stalled one does to the others is the policy
    between watermarks (``spark.sql.streaming.multipleWatermarkPolicy``): with ``max`` they go on, at most ``lateness`` behind
    the fastest source; with ``min`` they wait for it."""
    own = [
        (df.select(*columns, at) if columns else df).withColumn("source_id", F.lit(k).cast("long")).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness)
        for k, df in sources.items()
    ]
    return reduce(DataFrame.unionByName, own)


def batched(rows: DataFrame, at: str = "arrived", push_ms: int = PUSH_MS, most: int = SOURCES) -> DataFrame:
    """``start, part, sources, n``: frames that arrived within ``push_ms`` as one batch, with its sources and frames in order, ``(source_id, frame)``.

    Sources are dealt to ``parts`` of ``most``, so that a batch holds those of a part and grows with no more."""
    part = F.floor(F.col("source_id") / most).alias("part")
    by = rows.groupBy(F.window(at, f"{push_ms} milliseconds").alias("w"), part)
    found = by.agg(F.sort_array(F.collect_list(F.struct("source_id", "frame"))).alias("frames"))
    sources = F.array_distinct(F.transform("frames", lambda x: x["source_id"]))
    return found.select(F.col("w.start").alias("start"), "part", sources.alias("sources"), F.size("frames").alias("n"), "frames")


def requests(det: DataFrame) -> DataFrame:
    """Rows at which a track's score (area by confidence, in the region) is the best so far: these ask for a crop."""
    own = Window.partitionBy("channel_id", "track_id").orderBy("frame", "det_ord").rowsBetween(Window.unboundedPreceding, -1)
    scored = det.where("in_roi").withColumn("score", F.col("w") * F.col("h") * F.col("confidence"))
    best = scored.withColumn("_best", F.max("score").over(own)).where("_best is null or score > _best")
    return best.select("channel_id", "track_id", "frame", "pts_ms", "x", "y", "w", "h", "score")


def crops(asked: DataFrame, pictures: DataFrame, wait_ms: int = 2000, lateness: str | None = None) -> DataFrame:
    """Each request with the picture of its own frame, and where the crop is cut from it; null where none came in time.

    ``asked``: ``channel_id, track_id, frame, pts_ms, x, y, w, h, score``; ``pictures``: ``channel_id, frame, pts_ms, picture, width, height``. Tables or streams; for streams,
    ``lateness`` sets the watermarks of both, by which a request waits for its picture for ``wait_ms`` and the state forgets either."""
    a = asked.withColumnsRenamed({"frame": "asked_frame", "channel_id": "asked_channel"})
    b = pictures
    if lateness:
        a, b = on_clock(a, lateness).withColumnRenamed("at", "asked_at"), on_clock(b, lateness).withColumnRenamed("at", "seen_at")
    else:
        a, b = (x.withColumn(c, F.timestamp_millis("pts_ms")) for x, c in ((a, "asked_at"), (b, "seen_at")))
    b = b.drop("pts_ms")
    inside = (F.col("seen_at") >= F.col("asked_at")) & (F.col("seen_at") <= F.col("asked_at") + F.expr(f"INTERVAL {wait_ms / 1000} SECONDS"))
    met = a.join(b, (F.col("asked_channel") == F.col("channel_id")) & (F.col("asked_frame") == F.col("frame")) & inside, "left")
    cut = G.snapshot_crop(*[F.col(c) for c in ("x", "y", "w", "h", "width", "height")])
    return met.select(
        F.col("asked_channel").alias("channel_id"), "track_id", F.col("asked_frame").alias("frame"), "score", "picture",
        *[F.when(F.col("picture").isNotNull(), v).alias(k) for k, v in cut.items()],
    )


def best_crops(found: DataFrame) -> DataFrame:
    """Of each track, the crop of the highest score that was cut, the earliest of equal ones."""
    own = found.where("picture is not null")
    best = F.max_by(F.struct(*[c for c in own.columns if c not in ("channel_id", "track_id")]), F.struct("score", (-F.col("frame")).alias("f")))
    return own.groupBy("channel_id", "track_id").agg(best.alias("b")).select("channel_id", "track_id", "b.*")


def samples(frames: DataFrame, every_ms: int = 1000) -> DataFrame:
    """The first frame of every ``every_ms`` of each video: ``site, video, slot, frame``."""
    slot = F.floor(F.col("pts_ms") / every_ms).alias("slot")
    return frames.groupBy("site", "video", slot).agg(F.min_by("frame", F.struct("pts_ms", "frame")).alias("frame"))


def numbered(found: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Samples with ``number``, counted on from 1 by site in the order of videos, after those that are ``done`` (``site, number``)."""
    rows = running(found, ["site"], ["video", "slot"], {"number": F.lit(1).cast("long")})
    if done is None:
        return rows
    upto = done.groupBy(F.col("site").alias("_site")).agg(F.max("number").alias("_upto"))
    met = rows.join(upto, F.col("site").eqNullSafe(F.col("_site")), "left")
    return met.select(*found.columns, (F.col("number") + F.coalesce("_upto", F.lit(0).cast("long"))).alias("number"))


def read_samples(spark: SparkSession, folder: str) -> DataFrame | None:
    """All samples taken so far, with the ``batch`` that took them."""
    try:
        return spark.read.parquet(folder)
    except AnalysisException as none_yet:
        if none_yet.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def sample_once(frames: DataFrame, folder: str, checkpoint: str, every_ms: int = 1000) -> StreamingQuery:
    """Takes samples of the videos that have not been sampled yet, then stops; run it again after more have come, or after a failure.

    ``frames``: a stream of files, one for each video: ``site, video, frame, pts_ms``. The checkpoint knows the files that are
    done. A batch writes a folder of its own and replaces it if it is run again, and numbers go on from
    those of the batches before, so each sample is there once, with the same number, wherever a run was stopped."""

    def write(batch: DataFrame, number: int) -> None:
        done = read_samples(batch.sparkSession, folder)
        done = None if done is None else done.where(F.col("batch") < number).select("site", "number")
        numbered(samples(batch, every_ms), done).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return frames.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

