"""Lookups, scalar functions and summaries, each with its SQL equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions import geometry as G
from kerbside.operators import alerts
from kerbside.plans.alert_queries import ALERTS, base
from kerbside.plans.track_queries import det
from kerbside.sources import detections as D

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Names to class numbers; others are dropped. A fixed table of the test site.
CLASS_IDS = {"click": 0, "purchase": 1, "signup": 2, "view": 3}


@query(
    "SELECT class_id, count(*) AS n FROM (SELECT CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 END AS class_id FROM events)"
    " WHERE class_id IS NOT NULL GROUP BY ALL"
)
def class_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.create_map(*[F.lit(x) for pair in CLASS_IDS.items() for x in pair])
    mapped = D.read_events(spark, sf_dir).select(F.try_element_at(known, F.col("event_type")).alias("class_id"))
    return mapped.where("class_id is not null").groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {D.DET_SQL}, a AS (SELECT channel_id, det_ord, least(100.0, greatest(0.0, x / 19.2)) AS l, least(100.0, greatest(0.0, (x + w) / 19.2)) AS r,"
    " least(100.0, greatest(0.0, y / 10.8)) AS t, least(100.0, greatest(0.0, (y + h) / 10.8)) AS b FROM det WHERE class_name <> 'view')"
    " SELECT channel_id, count(*) AS n, round(avg((r - l) * (b - t)), 6) AS mean_area FROM a WHERE r > l AND b > t GROUP BY ALL"
)
def annotation_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in percent of a picture of 1920 by 1080, clipped to it; unknown classes and empty boxes go."""
    part = lambda v, whole: F.least(F.lit(100.0), F.greatest(F.lit(0.0), v / whole))
    rows = det(spark, sf_dir).where("class_name <> 'view'").select(
        "channel_id", part(F.col("x"), 19.2).alias("l"), part(F.col("x") + F.col("w"), 19.2).alias("r"), part(F.col("y"), 10.8).alias("t"),
        part(F.col("y") + F.col("h"), 10.8).alias("b"),
    ).where("r > l and b > t")
    area = (F.col("r") - F.col("l")) * (F.col("b") - F.col("t"))
    return rows.groupBy("channel_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(area), 6).alias("mean_area"))


@query(
    "SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS stem, max(page_id) AS task, max_by(url, page_id) AS url, count(*) AS n FROM pages GROUP BY ALL"
)
def tasks_by_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of tasks with the same stem, the last one wins."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    stem = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    return rows.groupBy(stem.alias("stem")).agg(F.max("page_id").alias("task"), F.max_by("url", "page_id").alias("url"), F.count(F.lit(1)).alias("n"))


@query(
    "SELECT conv_id, max_by(text, coalesce(turn, -1)) AS latest, count(*) AS versions FROM conversations GROUP BY ALL"
)
def latest_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.groupBy("conv_id").agg(F.max_by("text", F.coalesce("turn", F.lit(-1))).alias("latest"), F.count(F.lit(1)).alias("versions"))


@query(
    f"WITH {D.DET_SQL} SELECT count(DISTINCT channel_id * 1000000000 + frame) AS frames, count(*) AS detections, count(DISTINCT track_id) AS tracks,"
    " round(count(*)::DOUBLE / count(DISTINCT channel_id * 1000000000 + frame), 4) AS per_frame, max(pts_ms) AS last_pts FROM det"
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = F.countDistinct(F.col("channel_id") * 1_000_000_000 + F.col("frame"))
    return det(spark, sf_dir).agg(
        frames.alias("frames"), F.count(F.lit(1)).alias("detections"), F.countDistinct("track_id").alias("tracks"),
        F.round(F.count(F.lit(1)) / frames, 4).alias("per_frame"), F.max("pts_ms").alias("last_pts"),
    )


@query(
    f"{ALERTS} SELECT alert_id, 700 + greatest(0, first_pts - 1000) AS clock, (seq % 7919) % (duration_ms + 1000) AS looped,"
    " 700 + greatest(0, first_pts - 1000) BETWEEN first_pts AND last_pts AS visible, CAST(least(500 * pow(2, seq % 6), 5000) AS BIGINT) AS backoff FROM alerts"
)
def replay_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip's clock on the video, the place of a looped animation, visibility, and a reconnection's wait."""
    clock = 700 + F.greatest(F.lit(0), F.col("first_pts") - 1000)
    return base(spark, sf_dir).select(
        "alert_id", clock.alias("clock"), F.pmod(F.col("seq") % 7919, F.col("duration_ms") + 1000).alias("looped"),
        clock.between(F.col("first_pts"), F.col("last_pts")).alias("visible"),
        F.least(500 * F.pow(F.lit(2), F.col("seq") % 6), F.lit(5000)).cast("long").alias("backoff"),
    )


@query(
    f"{ALERTS}, m AS (SELECT type || '_alert' AS type, channel FROM alerts UNION ALL SELECT 'track_ended', channel FROM alerts WHERE type = 'transit'"
    " UNION ALL SELECT 'channel_added', range FROM range(3)) SELECT type, channel, count(*) AS n FROM m GROUP BY ALL"
)
def typed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All message types in one stream; each carries its type and channel."""
    own = base(spark, sf_dir)
    alerts_ = own.select(F.concat("type", F.lit("_alert")).alias("type"), "channel")
    ended = own.where("type = 'transit'").select(F.lit("track_ended").alias("type"), "channel")
    added = spark.range(3).select(F.lit("channel_added").alias("type"), F.col("id").alias("channel"))
    return alerts_.unionByName(ended).unionByName(added).groupBy("type", "channel").agg(F.count(F.lit(1)).alias("n"))


CROPS = f"""WITH {D.DET_SQL}, g AS (
    SELECT *, greatest(w, h) AS side, least(w, h) AS short, least(least(w, h) + 2 * CAST(ceil(least(w, h) / 2.0) AS BIGINT), greatest(w, h)) AS scene FROM det),
e AS (
    SELECT *, (scene - short) // 2 AS a, scene - short - (scene - short) // 2 AS b, (side - scene) // 2 AS pad FROM g),
c AS (
    SELECT *, CASE WHEN w >= h THEN x ELSE x - a END AS l, CASE WHEN w >= h THEN x + w ELSE x + w + b END AS r, CASE WHEN w >= h THEN y - a ELSE y END AS t,
        CASE WHEN w >= h THEN y + h + b ELSE y + h END AS u FROM e),
cut AS (
    SELECT *, greatest(l, 0) AS src_x1, greatest(t, 0) AS src_y1, least(r, 1920) AS src_x2, least(u, 1080) AS src_y2,
        CASE WHEN w >= h THEN 0 ELSE pad END + greatest(l, 0) - l AS dst_x, CASE WHEN w >= h THEN pad ELSE 0 END + greatest(t, 0) - t AS dst_y FROM c)"""


@query(
    f"{CROPS}, s AS (SELECT *, 640.0::DOUBLE / 1920 AS s FROM cut), p AS (SELECT *, 140 AS pad_y, x * s AS bx, y * s + 140 AS by_, (x + w) * s AS bx2, (y + h) * s + 140 AS by2 FROM s)"
    " SELECT det_ord, side, src_x1, src_y1, src_x2, src_y2, dst_x, dst_y, round(bx, 6) AS boxed_x, round(by_, 6) AS boxed_y, round(least(greatest(x, 0), 1920), 6)::DOUBLE AS back_x1,"
    " round(least(greatest(y, 0), 1080), 6)::DOUBLE AS back_y1, round(least(greatest(x + w, 0), 1920), 6)::DOUBLE AS back_x2, round(least(greatest(y + h, 0), 1080), 6)::DOUBLE AS back_y2 FROM p"
)
def picture_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square pictures of boxes, and boxes put on a letterboxed square and taken back from it."""
    x, y, w, h = (F.col(c) for c in ("x", "y", "w", "h"))
    wide, tall = F.lit(1920), F.lit(1080)
    scale, pad_x, pad_y = G.letterbox(wide, tall, 640)
    on = [x * scale + pad_x, y * scale + pad_y, (x + w) * scale + pad_x, (y + h) * scale + pad_y]
    back = G.from_letterbox(on, wide, tall, 640)
    return det(spark, sf_dir).select(
        "det_ord", *[v.alias(k) for k, v in G.snapshot_crop(x, y, w, h, wide, tall).items()], F.round(on[0], 6).alias("boxed_x"), F.round(on[1], 6).alias("boxed_y"),
        *[F.round(v, 6).alias(f"back_{k}") for k, v in zip(("x1", "y1", "x2", "y2"), back)],
    )


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY ALL")
def parsed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists as clients send them, with blanks and empty parts, parsed."""
    sent = D.read_events(spark, sf_dir).groupBy("user_id").agg(F.concat_ws(" , ,", F.sort_array(F.collect_set("event_type"))).alias("sent"))
    return sent.select("user_id", F.array_join(alerts.parse_list(F.col("sent")), ",").alias("types"))


@query(
    "WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY ALL), f AS (SELECT min_by(n, source) AS first_n FROM n)"
    " SELECT source, n, first_n, round((n - first_n)::DOUBLE / first_n, 4) AS change FROM n, f"
)
def change_against_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of several runs against those of the first; one row a run."""
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    first = n.agg(F.min_by("n", "source").alias("first_n"))
    found = n.join(F.broadcast(first))
    return found.withColumn("change", F.round((F.col("n") - F.col("first_n")) / F.col("first_n"), 4))
