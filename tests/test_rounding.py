"""Rounded figures of messages and alerts against DuckDB, at ties of the last place."""

import json

import duckdb
from pyspark.sql import functions as F

from kerbside.functions import geometry as G
from kerbside.operators import alerts


def test_ties_round_as_in_sql(spark):
    values = [k / 10_000 for k in range(-50, 10_000, 5)] + [0.25 + k * 0.3 / 600 for k in range(0, 1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (1, 2, 3):
        got = [r.r for r in df.select(G.rounded(F.col("v"), places).alias("r")).collect()]
        assert got == [r for (r,) in duckdb.execute("SELECT round(unnest(?::DOUBLE[]), ?)", [values, places]).fetchall()]


def test_frame_messages_round_a_score_as_in_sql(spark):
    scores = [0.5065, 0.5005, 0.2505]  # the first two fall short of the tie once they are scaled
    rows = [(1, k, 33, 7, "car", 0, 0, 10, 10, s, 5, 5, k) for k, s in enumerate(scores)]
    names = "channel_id long, frame long, pts_ms long, track_id long, class_name string, x long, y long, w long, h long, confidence double, cx long, cy long, det_ord long"
    found = alerts.frame_messages(spark.createDataFrame(rows, names)).orderBy("frame").collect()
    assert [json.loads(r.message)["tracks"][0]["confidence"] for r in found] == [0.506, 0.5, 0.251]
