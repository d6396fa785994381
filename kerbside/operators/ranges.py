"""Running figures over keys of any size: no task sees all rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.storage import materialize


def running(
    rows: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None
) -> DataFrame:
    """Adds ``sums`` and ``maxima`` (new name: what of) over the rows of the same keys up to each row.

    Rows are dealt by ranges of (keys, order), counted within their range, and take over what the key has in the ranges
    before it. Rows that ``order`` cannot tell apart stand in any order."""
    figures = {**{n: (F.sum, c) for n, c in (sums or {}).items()}, **{n: (F.max, c) for n, c in (maxima or {}).items()}}
    ranged = materialize(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    held = ranged.groupBy("_part", *keys).agg(*[f(c).alias(n) for n, (f, c) in figures.items()])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select(*[F.col(k).alias(f"_of_{k}") for k in ("_part", *keys)], *[f(n).over(earlier).alias(f"_before_{n}") for n, (f, _) in figures.items()])
    here = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.select("*", *[f(c).over(here).alias(n) for n, (f, c) in figures.items()])
    same = F.col("_part") == F.col("_of__part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    met = own.join(before, same, "left")
    both = [
        F.coalesce(F.col(n) + F.col(f"_before_{n}"), n, f"_before_{n}").alias(n) if n in (sums or {}) else F.greatest(n, f"_before_{n}").alias(n)
        for n in figures
    ]
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], *both)
