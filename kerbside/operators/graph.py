"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.storage import discard, materialize


#: Links of a node from which on its rows stay where they are, and at most so many nodes that count as such.
HUB, HUBS = 1000, 100_000


def _with_least(both: DataFrame, least: DataFrame, links: int) -> DataFrame:
    """The links ``(u, v)`` with ``m``, the least node beside ``u``. Few nodes can have very many links, so these are
    broadcast, and no task gets all links of one; the rest meet by a shuffle."""
    hub = max(HUB, 2 * links // HUBS)
    hubs = least.where(F.col("n") > hub).select("u", "m")
    at_hubs = both.join(F.broadcast(hubs), "u")
    return at_hubs.unionByName(both.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.select("u", "m"), "u"))


def components(edges: DataFrame, name: str) -> DataFrame:
    """``(node, component)`` for every node of the links ``(a, b)``; a component is its smallest node.

    Alternates the large-star and small-star steps until the links no longer change. Each step keeps as
    many links as it gets at most; minima combine before the shuffle, so that a hub costs no more than its links.
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )
    sign, links = None, now.count()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _with_least(both, least, links).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        last, now = now, materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name)
        discard(last)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == sign:
            break
        sign, links = seen, seen[0]
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
