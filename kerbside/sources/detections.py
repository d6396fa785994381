"""Detection rows derived from the ``events`` table, deterministically, and the test site's arms and region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbside import schemas

#: (arm, x1, y1, x2, y2, junction side), in the order in which arms are tried.
ARMS = [
    ("east", 1600, 200, 1600, 900, "left"),
    ("north", 300, 200, 1600, 200, "left"),
    ("south", 300, 900, 1600, 900, "right"),
    ("west", 300, 200, 300, 900, "right"),
]
ROI = [(250, 150), (1650, 150), (1650, 950), (250, 950)]
FRAME_MS = 33


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def detections(events: DataFrame, frame_ms: int = FRAME_MS, piece: int = 0) -> DataFrame:
    """One row for each event: the user is a vehicle that moves by a fixed step. Three cameras see 150 vehicles, so that
    more vehicles are more channels, as with more sites. With ``piece``, its track breaks after
    so many rows and goes on under a new id, some frames later."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    user = F.col("user_id")
    still = user % 10 == 0
    vx = F.when(still, 0).otherwise((user * 7) % 31 - 15)
    vy = F.when(still, 0).otherwise((user * 11) % 23 - 11)
    df = events.select("user_id", "event_id", "event_type", "value", n.alias("n"))
    part = F.floor((F.col("n") - 1) / piece) if piece else F.lit(0).cast("long")
    frame = F.col("n") + user % 40 + part * (1 + user % 90)
    df = df.select(
        (F.floor(user / 150) * 3 + user % 3).alias("channel_id"), frame.alias("frame"), (frame * frame_ms).alias("pts_ms"),
        (user * 10 + part if piece else user).alias("track_id"), F.col("event_type").alias("class_name"),
        (200 + (user * 53) % 1500 + vx * (F.col("n") - 1)).alias("cx"), (150 + (user * 29) % 700 + vy * (F.col("n") - 1)).alias("cy"),
        (40 + (user % 5) * 20).alias("w"), (30 + (F.col("event_id") % 7) * 5).alias("h"),
        F.least(F.lit(0.99), 0.25 + F.col("value") / 600).alias("confidence"), F.col("event_id").alias("det_ord"),
    )
    left = (F.col("cx") - F.floor(F.col("w") / 2)).alias("x")
    top = (F.col("cy") - F.floor(F.col("h") / 2)).alias("y")
    return df.select(
        "channel_id", "frame", "pts_ms", "track_id", "class_name", left, top, "w", "h", "confidence", "cx", "cy", "det_ord"
    )


#: The same in SQL: a common table expression ``det``.
DET_SQL = """numbered AS (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
moving AS (
    SELECT *, CASE WHEN user_id % 10 = 0 THEN 0 ELSE (user_id * 7) % 31 - 15 END AS vx,
        CASE WHEN user_id % 10 = 0 THEN 0 ELSE (user_id * 11) % 23 - 11 END AS vy FROM numbered),
det AS (
    SELECT user_id // 150 * 3 + user_id % 3 AS channel_id, n + user_id % 40 AS frame, (n + user_id % 40) * 33 AS pts_ms, user_id AS track_id,
        event_type AS class_name, 200 + (user_id * 53) % 1500 + vx * (n - 1) - (40 + (user_id % 5) * 20) // 2 AS x,
        150 + (user_id * 29) % 700 + vy * (n - 1) - (30 + (event_id % 7) * 5) // 2 AS y,
        40 + (user_id % 5) * 20 AS w, 30 + (event_id % 7) * 5 AS h, least(0.99::DOUBLE, 0.25::DOUBLE + value / 600) AS confidence,
        200 + (user_id * 53) % 1500 + vx * (n - 1) AS cx, 150 + (user_id * 29) % 700 + vy * (n - 1) AS cy, event_id AS det_ord
    FROM moving)"""

FRAGMENTED_SQL = """numbered AS (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
det AS (
    SELECT user_id // 150 * 3 + user_id % 3 AS channel_id, n + user_id % 40 + (n - 1) // 30 * (1 + user_id % 90) AS frame,
        (n + user_id % 40 + (n - 1) // 30 * (1 + user_id % 90)) * 33 AS pts_ms, user_id * 10 + (n - 1) // 30 AS track_id, event_type AS class_name,
        200 + (user_id * 53) % 1500 + (CASE WHEN user_id % 10 = 0 THEN 0 ELSE (user_id * 7) % 31 - 15 END) * (n - 1) AS cx,
        150 + (user_id * 29) % 700 + (CASE WHEN user_id % 10 = 0 THEN 0 ELSE (user_id * 11) % 23 - 11 END) * (n - 1) AS cy, event_id AS det_ord
    FROM numbered)"""

ARMS_SQL = "arms(arm_id, arm_ord, x1, y1, x2, y2, junction_side) AS (VALUES " + ", ".join(
    f"('{a}', {k}, {x1}, {y1}, {x2}, {y2}, '{side}')" for k, (a, x1, y1, x2, y2, side) in enumerate(ARMS)
) + ")"


def arms(spark: SparkSession, site_id: str = "test") -> DataFrame:
    rows = [(site_id, a, k, a.title(), *map(float, xy), side) for k, (a, *xy, side) in enumerate(ARMS)]
    return spark.createDataFrame(rows, schemas.ARMS)
