"""Alert rows: derived statistics, reads, deletes, subscriptions and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions.geometry import rounded
from kerbside.operators.tracks import duration_ms

#: Columns that summaries leave out; they are the large ones.
HEAVY = ("full_trajectory", "per_frame_data")
QUEUE = 256


def from_tracks(det: DataFrame) -> DataFrame:
    """One alert for each track, with its trajectory: of standing vehicles a stagnation, of others a transit."""
    one = F.struct("frame", F.array("x", "y", "w", "h").alias("bbox"), "cx", "cy", "confidence", "pts_ms")
    by = det.groupBy("channel_id", "track_id").agg(
        F.sort_array(F.collect_list(one)).alias("per_frame_data"), F.min("frame").alias("first_seen_frame"),
        F.max("frame").alias("last_seen_frame"), F.min("pts_ms").alias("first_pts"), F.max("pts_ms").alias("last_pts"),
        F.count(F.lit(1)).alias("frames_tracked"), rounded(F.avg("confidence"), 2).alias("avg_confidence"),
        rounded(F.max("confidence"), 2).alias("max_confidence"), F.min_by("class_name", "frame").alias("class_name"),
    )
    kind = F.when(F.col("track_id") % 10 == 0, "stagnant").otherwise("transit")
    # the id is derived from what the alert is about: a repeated run gives the same one
    alert_id = F.substring(F.sha2(F.concat_ws(":", "channel_id", "track_id", "last_seen_frame", kind), 256), 1, 8)
    frames = F.col("last_seen_frame") - F.col("first_seen_frame")
    return by.select(
        alert_id.alias("alert_id"), kind.alias("type"), F.col("channel_id").alias("channel"), F.col("track_id").cast("string").alias("track_id"),
        "class_name", "first_seen_frame", "last_seen_frame", "first_pts", "last_pts",
        duration_ms(F.col("first_pts"), F.col("last_pts"), frames, F.col("frames_tracked")).alias("duration_ms"),
        "avg_confidence", "max_confidence", "frames_tracked", F.lit(0).alias("frames_stationary"),
        F.transform("per_frame_data", lambda p: F.struct(p["cx"].alias("x"), p["cy"].alias("y"), p["frame"].alias("frame"))).alias("full_trajectory"),
        F.slice("per_frame_data", F.greatest(F.size("per_frame_data") - 299, F.lit(1)), 300).alias("per_frame_data"),
        (F.col("last_seen_frame") * 1_000_000 + F.col("track_id")).alias("seq"),
    )


def summaries(alerts: DataFrame) -> DataFrame:
    return alerts.drop(*HEAVY)


def read(alerts: DataFrame, limit: int = 50, type: str | None = None, channel: int | None = None) -> DataFrame:  # noqa: A002
    """The newest summaries; between 1 and 200 of them."""
    if not 1 <= limit <= 200:
        raise ValueError("limit is 1 to 200")
    kept = [F.col(c) == v for c, v in (("type", type), ("channel", channel)) if v is not None]
    for condition in kept:
        alerts = alerts.where(condition)
    return summaries(alerts).orderBy(F.desc("seq")).limit(limit)


def by_ids(alerts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Whole alerts of the ids in ``wanted``; an id that is not there has no row."""
    return alerts.join(wanted.select("alert_id").distinct(), "alert_id", "left_semi")


def of_channel(alerts: DataFrame, channel: int) -> DataFrame:
    """All of a channel's alerts with their heavy columns, as replays and exports need them."""
    return alerts.where(F.col("channel") == channel)


def tabs(alerts: DataFrame) -> DataFrame:
    """How many alerts each tab of a list shows."""
    of = lambda name: F.count_if(F.col("type") == name).alias(name)
    return alerts.agg(F.count(F.lit(1)).alias("all"), of("transit"), of("stagnant"))


def direction_text(kind: Column, entry: Column, exit_: Column) -> Column:
    """``N ↣ S`` of a transit's arms, ``?`` for one that is not known."""
    first = lambda arm: F.upper(F.substring(F.coalesce(F.nullif(arm, F.lit("")), F.lit("?")), 1, 1))
    return F.when(kind == "transit", F.concat(first(entry), F.lit(" \u21a3 "), first(exit_))).otherwise("Stagnant")


def duration_text(kind: Column, frames: Column, ms: Column, still_frames: Column, still_ms: Column) -> Column:
    """By frames if they are known, else by the clock; of stagnations, how long they stood; nothing if that is 0 or null."""
    # to one place by the exact value of the number, as browsers round; an exact tie goes up
    tie = lambda x: F.when(F.pmod(x * 4, F.lit(2)) == 1, F.floor(x * 10 + 0.5) / 10).otherwise(x)
    tenths = lambda x: F.when(x != 0, F.concat(F.translate(F.format_number(tie(x), 1), ",", ""), F.lit("s")))
    whole = lambda x: F.when(x != 0, F.concat(F.floor(x + 0.5).cast("string"), F.lit("s")))
    moved, stood = tenths(ms / 1000), F.coalesce(whole(still_frames / 30.0), whole(still_ms / 1000))
    return F.coalesce(tenths(frames / 30.0), F.when(kind == "transit", moved).otherwise(stood), F.lit(""))


def with_channel_state(alerts: DataFrame, states: DataFrame) -> DataFrame:
    """Alerts with the ``phase`` and ``source`` of their channel; those that come when it is under review have their
    clip cut at once, and those of unknown channels wait. ``states`` has a row for each channel."""
    both = alerts.join(states, "channel", "left")
    return both.withColumn("clip", F.when(F.col("phase") == "review", "now").when(F.col("phase").isNull(), "waits").otherwise("at the end"))


def without_channel(alerts: DataFrame, channel: int) -> DataFrame:
    return alerts.where(~F.col("channel").eqNullSafe(channel))


def delivered(messages: DataFrame, channels: list[int] | None, types: list[str] | None) -> DataFrame:
    """Messages that a client with these filters gets; those without a channel or type pass."""
    if channels:
        messages = messages.where(F.col("channel").isNull() | F.col("channel").isin(channels))
    if types:
        messages = messages.where(F.col("type").isNull() | F.col("type").isin(types))
    return messages


def parse_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def queued(messages: DataFrame, size: int = QUEUE) -> DataFrame:
    """What is left in each channel's queue that drops its oldest messages."""
    newest = Window.partitionBy("channel").orderBy(F.desc("seq"))
    return messages.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= size).drop("_r")


def merged(live: DataFrame, backfill: DataFrame) -> DataFrame:
    """Both, an alert of the same id once: live first."""
    both = live.withColumn("_p", F.lit(0)).unionByName(backfill.withColumn("_p", F.lit(1)))
    first = Window.partitionBy("alert_id").orderBy("_p")
    return both.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_p")


def clip_window(first_pts: Column, last_pts: Column) -> tuple[Column, Column, Column]:
    """Start and end of a transit's clip, and the place of a stagnation's still, in seconds."""
    return F.greatest(F.lit(0.0), first_pts / 1000 - 1.0), last_pts / 1000 + 0.5, (first_pts + last_pts) / 2 / 1000


def frame_messages(det: DataFrame) -> DataFrame:
    """One JSON message for each frame, its tracks with the fields that clients draw."""
    track = F.struct(
        F.col("track_id").cast("string").alias("id"), F.col("class_name").alias("class"), F.array("x", "y", "w", "h").alias("bbox"),
        rounded(F.col("confidence"), 3).alias("confidence"), F.array("cx", "cy").alias("centroid"),
    )
    frames = det.groupBy("channel_id", "frame").agg(F.sort_array(F.collect_list(track)).alias("tracks"), F.max("pts_ms").alias("pts_ms"))
    body = F.struct(F.lit("frame_data").alias("type"), F.col("channel_id").alias("channel"), "frame", "pts_ms", "tracks")
    return frames.select("channel_id", "frame", F.to_json(body).alias("message"))


def age_text(seconds: Column) -> Column:
    return (
        F.when(seconds < 60, "just now")
        .when(seconds < 3600, F.concat(F.floor(seconds / 60), F.lit("m ago")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600), F.lit("h ago")))
        .otherwise(F.concat(F.floor(seconds / 86400), F.lit("d ago")))
    )


def fps_level(fps: Column) -> Column:
    return F.when(fps < 5, "red").when(fps < 15, "amber").otherwise("green")


def latency_level(ms: Column) -> Column:
    return F.when(ms > 40, "red").when(ms > 20, "amber").otherwise("green")
