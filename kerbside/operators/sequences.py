"""Order-dependent operators over a key's rows: as-of lookup, rate caps, idling, breakers, sessions, ranks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_forward(asked: DataFrame, rows: DataFrame, keys: list[str], at: str, value: str, number: str) -> DataFrame:
    """For each asked moment, ``value`` of the first row at or after it, of the last row if there is none.

    Both are put in one order by key and time and looked up by one window; nothing is joined."""
    both = asked.select(*keys, at, number, F.lit(None).cast("long").alias(value), F.lit(0).alias("_row")).unionByName(
        rows.select(*keys, at, F.lit(None).cast("long").alias(number), F.col(value).cast("long").alias(value), F.lit(1).alias("_row"))
    )
    order = Window.partitionBy(*keys).orderBy(at, "_row")
    ahead = F.first(value, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    last = F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    found = both.select(*keys, number, "_row", F.coalesce(ahead, last).alias(value))
    return found.where("_row = 0").drop("_row")


def tumbling(rows: DataFrame, at: str, width: str, key: str, value: str) -> DataFrame:
    """Count, mean and last value of each key and window; the key is dealt out by window too, so a hot one is many groups."""
    by = rows.groupBy(F.col(key).alias("channel"), F.window(at, width).alias("w"))
    found = by.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 8).alias("avg_value"), F.max_by(value, at).alias("last_value"))
    return found.select("channel", F.col("w.start").alias("start"), "n", "avg_value", "last_value")


def watchdog(rows: DataFrame, key: str, at: str, silence: str) -> DataFrame:
    """Stretches of a source without a silence of this length."""
    by = rows.groupBy(key, F.session_window(at, silence))
    return by.agg(F.min(at).alias("start"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("n")).drop("session_window")


def breaker(rows: DataFrame, key: str, at: str, seconds: int, most: int) -> DataFrame:
    """Adds ``tripped``: ``most`` rows or more in the last ``seconds``, the row at their open end not among them."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    recent = Window.partitionBy(key).orderBy("_t").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return rows.withColumn("_t", micros).withColumn("tripped", F.count(F.lit(1)).over(recent) >= most).drop("_t")


#: Milliseconds of a key that one task thins out at a time.
SLICE_MS = 60_000


def _kept(times: np.ndarray, first: int, least: float) -> np.ndarray:
    """Places that are kept if ``first`` is: each the first one late enough after the one before."""
    out, at = [], first
    while at < len(times):
        out.append(at)
        at = max(at + 1, int(np.searchsorted(times, times[at] + least, "left")))
    return np.array(out, int)


def rate_cap(frames: DataFrame, keys: str | list[str], at: str, fps: float, slice_ms: int = SLICE_MS) -> DataFrame:
    """Frames of which each comes late enough after the last one kept. That depends on what was kept, not on the row before.

    A key (a channel, or a channel and its epoch) is cut into slices of time. Whatever was kept before a slice, its first kept
    frame is one of the few at its start; so each slice says what it would keep last after each of these, a short walk over the
    slices of a key tells which of them it is, and all slices are then thinned out side by side."""
    keys = [keys] if isinstance(keys, str) else keys
    least = 1000.0 / fps - 1
    types = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    own = ", ".join(f"`{k}` {types[k]}" for k in keys)
    names, schema = frames.columns, frames.schema
    rows = frames.withColumn("_slice", F.floor(F.col(at) / slice_ms))

    def ends(part: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(part[at].to_numpy(float))
        firsts = range(min(int(np.searchsorted(times, times[0] + least, "left")) + 1, len(times)))
        lasts = [float(times[_kept(times, k, least)[-1]]) for k in firsts]
        return pd.DataFrame([{**{k: part[k].iloc[0] for k in keys}, "_slice": part["_slice"].iloc[0], "_first": [float(times[k]) for k in firsts], "_last": lasts}])

    def entries(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = object(), -np.inf
        for part in parts:
            held = []
            for key, firsts, lasts in zip(part[keys].itertuples(index=False, name=None), part["_first"], part["_last"]):
                key = tuple(None if pd.isna(v) else v for v in key)
                if key != now:
                    now, last = key, -np.inf
                held.append(last)
                place = int(np.searchsorted(np.asarray(firsts), last + least, "left"))
                last = lasts[place] if place < len(lasts) else last
            yield part[[*keys, "_slice"]].assign(_before=held)

    def thin(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(at, kind="stable")
        times = part[at].to_numpy(float)
        first = int(np.searchsorted(times, part["_before"].iloc[0] + least, "left"))
        return part.iloc[_kept(times, first, least)][names]

    found = rows.groupBy(*keys, "_slice").applyInPandas(ends, f"{own}, _slice long, _first array<double>, _last array<double>")
    walked = found.repartition(*keys).sortWithinPartitions(*keys, "_slice").mapInPandas(entries, f"{own}, _slice long, _before double")
    same = F.col("_slice") == F.col("_s")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    met = rows.join(walked.select(F.col("_slice").alias("_s"), "_before", *[F.col(k).alias(f"_k_{k}") for k in keys]), same)
    return met.select(*frames.columns, "_slice", "_before").groupBy(*keys, "_slice").applyInPandas(thin, schema)


def idle(frames: DataFrame, after: int = 30, interval: int = 15) -> DataFrame:
    """Adds ``idle`` where more than ``after`` empty frames have followed each other, and ``every``, the sampling step."""
    order = Window.partitionBy("channel_id").orderBy("frame")
    run = F.sum(F.when(F.col("empty"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    own = Window.partitionBy("channel_id", "_run").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    streak = F.when(F.col("empty"), F.sum(F.when(F.col("empty"), 1).otherwise(0)).over(own)).otherwise(0)
    found = frames.withColumn("_run", run).withColumn("idle", streak > after).drop("_run")
    return found.withColumn("every", F.when(F.col("idle"), interval).otherwise(1))


def index_percentiles(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, extremes and percentiles by index. Equal values are counted first; ranks come from running counts, so no
    key's values are gathered in one list."""
    counted = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    own = Window.partitionBy(key)
    counted = counted.withColumn("upto", F.sum("c").over(own.orderBy(value))).withColumn("n", F.sum("c").over(own))
    at = lambda index: F.min(F.when(F.col("upto") > index, F.col(value)))
    n = F.col("n")
    return counted.groupBy(key).agg(
        F.round(F.sum(F.col(value) * F.col("c")) / F.sum("c"), 3).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"),
        at(F.floor(n / 2)).alias("p50"), at(F.floor(n * 0.99)).alias("p99"), at(F.greatest(F.lit(0), F.floor(n * 0.95) - 1)).alias("p95"),
    )
