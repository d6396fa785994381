"""Nearest vectors of a stated set of queries among all rows, in blocks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows and queries of a block; queries whose distances a task holds at once.
ROWS, QUERIES, AT_ONCE = 50_000, 4096, 256
NEAREST = "query_id long, vec_id long, d double"


def _nearest(rows: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of this block for each query of this one, none of them the query itself."""
    if not len(rows) or not len(asked):
        return pd.DataFrame({"query_id": [], "vec_id": [], "d": []})
    ids = rows["vec_id"].to_numpy()
    unit = lambda x: (m := np.stack(x.to_numpy()).astype(float)) / np.sqrt((m * m).sum(1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        vectors, queries = unit(rows["vec"]).T, unit(asked["query_vec"])
    out = []
    for start in range(0, len(queries), AT_ONCE):
        far = np.maximum(0.0, 1 - queries[start : start + AT_ONCE] @ vectors)
        far[np.isnan(far)] = np.inf  # a vector without length is near nothing
        for query, d in zip(asked["query_id"].to_numpy()[start : start + AT_ONCE], far):
            d[ids == query] = np.inf
            place = np.round(d, 9)
            near = np.flatnonzero(place <= np.partition(place, min(k, len(place)) - 1)[min(k, len(place)) - 1])
            near = near[np.isfinite(place[near])]
            near = near[np.lexsort((ids[near], place[near]))[:k]]
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[near], "d": d[near]}))
    return pd.concat(out)


def nearest(rows: DataFrame, queries: DataFrame, k: int, block_rows: int = ROWS, block_queries: int = QUERIES) -> DataFrame:
    """``query_id, vec_id, k, d``: of each query the k rows of least cosine distance, then of least id. ``rows``: ``vec_id, vec``;
    ``queries``: ``query_id, vec``, the rows of these ids themselves being left out.

    Every block of queries meets every block of rows in one task, as a product of matrices; a list of k goes into the one
    shuffle that follows. Vectors without length are near nothing."""
    n = max(1, math.ceil(queries.count() / block_queries))
    m = max(1, math.ceil(rows.count() / block_rows), rows.sparkSession.sparkContext.defaultParallelism // n)
    numbers = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    deal = lambda c, count: F.pmod(F.xxhash64(c), F.lit(count)).cast("int")
    a = rows.select("vec_id", "vec", deal("vec_id", m).alias("row_block"), numbers(n).alias("query_block"))
    b = queries.select("query_id", F.col("vec").alias("query_vec"), deal("query_id", n).alias("asked_by"), numbers(m).alias("asked_of"))
    found = a.groupBy("row_block", "query_block").cogroup(b.groupBy("asked_of", "asked_by")).applyInPandas(lambda x, y: _nearest(x, y, k), NEAREST)
    order = Window.partitionBy("query_id").orderBy(F.round("d", 9), "vec_id")
    return found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).select("query_id", "vec_id", "k", "d")
