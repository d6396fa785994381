"""Phases of channels: commands that take effect between two frames.

A command is ``channel_id, pts_ms, command_id, action``; it holds from the first row at or after its time. ``add`` brings
a channel up, in the phase of setup; ``remove`` takes it down; ``setup``, ``analytics`` and ``review`` change its phase.
Commands to a channel that is not up change nothing, and so does adding one that is. Every ``add`` and every
``analytics`` begins an epoch: trackers, stitchers and counters of the one before are not to be used on. Rows of channels
that are down or in review are not processed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.operators.ranges import running

SETUP, ANALYTICS, REVIEW = "setup", "analytics", "review"
ADD, REMOVE = "add", "remove"
#: Milliseconds of a channel that meet the commands in one group.
SLICE_MS = 60_000


def effective(commands: DataFrame) -> DataFrame:
    """The commands that change something, with the ``phase``, ``epoch`` and ``epoch_start`` after each, and the phase before."""
    order = Window.partitionBy("channel_id").orderBy("pts_ms", "command_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    ups = F.when(F.col("action").isin(ADD, REMOVE), F.col("action") == ADD)
    up = F.coalesce(F.last(ups, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    done = commands.withColumn("_up", up).where(F.col("_up") != (F.col("action") == ADD)).drop("_up")
    phase = F.when(F.col("action") == ADD, SETUP).when(F.col("action") != REMOVE, F.col("action"))
    fresh = F.col("action").isin(ADD, ANALYTICS)
    done = done.withColumn("phase", phase)
    return done.select(
        "channel_id", "pts_ms", "command_id", "action", "phase", F.lag("phase").over(order).alias("old_phase"), F.count_if(fresh).over(upto).alias("epoch"),
        F.last(F.when(fresh, F.col("pts_ms")), ignorenulls=True).over(upto).alias("epoch_start"), F.lead("pts_ms").over(order).alias("until"),
    )


def changes(commands: DataFrame) -> DataFrame:
    """``channel_id, pts_ms, command_id, old_phase, phase`` of every change from one phase to another."""
    moved = effective(commands).where(~F.col("action").isin(ADD, REMOVE) & (F.col("phase") != F.col("old_phase")))
    return moved.select("channel_id", "pts_ms", "command_id", "old_phase", "phase")


def phased(rows: DataFrame, commands: DataFrame) -> DataFrame:
    """Rows that are processed, with ``phase``, ``epoch`` and ``epoch_ms``, the time since the epoch began.

    Commands are few; what lies between two of them is cut into slices of SLICE_MS, and rows meet their slice, so
    that a busy channel is many groups."""
    spans = effective(commands).where(F.col("phase").isin(SETUP, ANALYTICS) & (F.col("until").isNull() | (F.col("until") > F.col("pts_ms"))))
    at = lambda c: F.floor(c / SLICE_MS)
    ends = rows.groupBy(F.col("channel_id").alias("_of")).agg(F.max("pts_ms").alias("_end"))
    spans = spans.join(ends, F.col("channel_id") == F.col("_of")).where("pts_ms <= _end")
    last = F.least("_end", F.coalesce(F.col("until") - 1, F.col("_end")))
    spans = spans.select(
        F.col("channel_id").alias("_of"), F.explode(F.sequence(at(F.col("pts_ms")), at(last))).alias("_slice"), F.col("pts_ms").alias("_from"), last.alias("_last"),
        "phase", "epoch", "epoch_start",
    )
    same = (F.col("channel_id") == F.col("_of")) & (at(F.col("pts_ms")) == F.col("_slice")) & F.col("pts_ms").between(F.col("_from"), F.col("_last"))
    return rows.join(spans, same).select(*rows.columns, "phase", "epoch", (F.col("pts_ms") - F.col("epoch_start")).alias("epoch_ms"))


def last_before_review(rows: DataFrame, commands: DataFrame) -> DataFrame:
    """``channel_id, command_id, frame``: for each change to review, the last ``frame`` that was processed before it, null if none was.

    Frames are counted by span of commands first; what a channel has before a change is then a running maximum over its spans."""
    done = phased(rows, commands).groupBy("channel_id", "epoch", "phase", F.col("pts_ms").alias("at")).agg(F.max("frame").alias("frame"))
    review = changes(commands).where(F.col("phase") == REVIEW).select("channel_id", "command_id", F.col("pts_ms").alias("at"))
    null = F.lit(None).cast("long")
    both = done.groupBy("channel_id", "at").agg(F.max("frame").alias("frame")).select("channel_id", null.alias("command_id"), "at", "frame")
    both = running(both.unionByName(review.withColumn("frame", null)), ["channel_id"], ["at", F.asc_nulls_last("command_id")], maxima={"best": F.col("frame")})
    return both.where("command_id is not null").select("channel_id", "command_id", F.col("best").alias("frame"))
