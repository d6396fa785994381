"""What the service answers, as joins of a table of requests with the tables of its state: a ``status`` (as HTTP has it) and what goes with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions import urls
from kerbside.operators.control import ANALYTICS, REVIEW, SETUP

OK, ACCEPTED, BAD, NOT_FOUND, INVALID, BROKEN = 200, 202, 400, 404, 422, 500
#: Milliseconds that running clip jobs of a channel have when it is cleaned up.
DRAIN_MS = 5000


def job_status(jobs: DataFrame, cleanups: DataFrame, now_ms: int, drain_ms: int = DRAIN_MS) -> DataFrame:
    """``alert_id, state, drained``: pending, ready or failed; null of jobs whose channel was cleaned up, with whether they ended in time.

    ``jobs``: ``alert_id, channel, submitted_ms, finished_ms, failed``, one for each alert; ``cleanups``: ``channel, at_ms``, one for each channel."""
    known = jobs.where(F.col("submitted_ms") <= now_ms).join(cleanups.where(F.col("at_ms") <= now_ms), "channel", "left")
    over = F.coalesce(F.col("finished_ms") <= now_ms, F.lit(False))
    state = F.when(F.col("at_ms").isNull(), F.when(~over, "pending").when(F.col("failed"), "failed").otherwise("ready"))
    drained = F.when(F.col("at_ms").isNotNull(), F.coalesce(F.col("finished_ms") <= F.col("at_ms") + drain_ms, F.lit(False)))
    return known.select("alert_id", state.alias("state"), drained.alias("drained"))


def replays(requests: DataFrame, alerts: DataFrame, status: DataFrame) -> DataFrame:
    """``request_id, alert_id, status, body``: the clip of an alert, a still of a stagnant one, or why there is none yet."""
    met = requests.join(alerts.select("alert_id", "type"), "alert_id", "left").join(status.select("alert_id", "state"), "alert_id", "left")
    code = F.when(F.col("type").isNull(), NOT_FOUND).when(F.col("state").isNull() | (F.col("state") == "pending"), ACCEPTED).when(F.col("state") == "failed", BROKEN).otherwise(OK)
    body = (
        F.when(F.col("type").isNull(), "Alert not found").when(F.col("state").isNull(), "not_started").when(F.col("state") == "pending", "extracting")
        .when(F.col("state") == "failed", "Clip extraction failed").when(F.col("type") == "stagnant", "image/jpeg").otherwise("video/mp4")
    )
    return met.select("request_id", "alert_id", code.alias("status"), body.alias("body"))


def channels(requests: DataFrame, states: DataFrame, alerts: DataFrame) -> DataFrame:
    """``request_id, channel, status, source, phase, alert_count`` of a channel. ``states``: ``channel, source, phase`` of those that are up."""
    counts = alerts.groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
    met = requests.join(states, "channel", "left").join(counts, "channel", "left")
    up = F.col("phase").isNotNull()
    return met.select(
        "request_id", "channel", F.when(up, OK).otherwise(NOT_FOUND).alias("status"), "source", "phase", F.when(up, F.coalesce("n", F.lit(0))).alias("alert_count"))


def snapshots(requests: DataFrame, hot: DataFrame, cold: DataFrame) -> DataFrame:
    """``request_id, status, channel, picture`` for the text ``track``: from the tracks at work, else from those that are over; of several channels
    with that track the first one. ``hot``, ``cold``: ``channel, track_id, picture``."""
    first = lambda df, name: df.groupBy(F.col("track_id").alias(f"{name}_track")).agg(
        F.min(F.struct("channel", "picture")).alias(name))
    wanted = F.when(F.col("track").rlike(r"^\s*[+-]?[0-9]+\s*$"), F.expr("try_cast(trim(track) AS BIGINT)"))
    asked = requests.withColumn("wanted", wanted)
    met = asked.join(first(hot, "hot"), F.col("wanted") == F.col("hot_track"), "left").join(first(cold, "cold"), F.col("wanted") == F.col("cold_track"), "left")
    found = F.coalesce("hot", "cold")
    code = F.when(F.col("wanted").isNull(), BAD).when(found.isNull(), NOT_FOUND).otherwise(OK)
    return met.select("request_id", code.alias("status"), found["channel"].alias("channel"), found["picture"].alias("picture"))


def phase_changes(requests: DataFrame, states: DataFrame) -> DataFrame:
    """``request_id, status, detail`` of requests ``channel, phase, corners, labels`` to change a phase: the number of corners of the region and
    the labels of the lines that come with it."""
    met = requests.join(states.select("channel", F.col("phase").alias("_now")), "channel", "left")
    starts = (F.col("_now") == SETUP) & (F.col("phase") == ANALYTICS)
    few = starts & (F.coalesce("corners", F.lit(0)) < 3)
    twice = starts & (F.size(F.array_distinct("labels")) < F.size("labels"))
    unknown = ~F.coalesce(F.col("phase").isin(SETUP, ANALYTICS, REVIEW), F.lit(False))
    detail = (
        F.when(unknown, "Invalid phase").when(F.col("_now").isNull(), "Channel not found").when(few, "ROI polygon with at least 3 vertices required to start analytics")
        .when(F.coalesce(twice, F.lit(False)), "Duplicate entry/exit line labels are not allowed")
    )
    code = F.when(detail.isNull(), OK).when(~unknown & F.col("_now").isNull(), NOT_FOUND).otherwise(INVALID)
    return met.select("request_id", code.alias("status"), detail.alias("detail"))


def sites(requests: DataFrame, known: DataFrame) -> DataFrame:
    """``request_id, status, corners`` of the document of a site. ``known``: ``site_id, roi``."""
    met = requests.join(known, "site_id", "left")
    fits = F.coalesce(F.col("site_id").rlike(urls.SITE_ID), F.lit(False))
    code = F.when(~fits, INVALID).when(F.col("roi").isNull(), NOT_FOUND).otherwise(OK)
    return met.select("request_id", code.alias("status"), F.when(code == OK, F.size("roi")).alias("corners"))


def last_frames(requests: DataFrame, kept: DataFrame) -> DataFrame:
    """``request_id, status, frame`` of the picture that a channel kept at its last change to review. ``kept``: ``channel, at, frame``."""
    last = kept.where("frame is not null").groupBy("channel").agg(F.max_by("frame", "at").alias("frame"))
    met = requests.join(last, "channel", "left")
    return met.select("request_id", F.when(F.col("frame").isNull(), NOT_FOUND).otherwise(OK).alias("status"), "frame")
