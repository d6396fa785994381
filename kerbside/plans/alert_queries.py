"""The read path over alerts, clocks and channel health, each with its SQL equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbside.operators import alerts, sequences
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


ALERTS = f"""WITH {D.DET_SQL}, alerts AS (
    SELECT substr(sha256(channel_id || ':' || track_id || ':' || max(frame) || ':' || CASE WHEN track_id % 10 = 0 THEN 'stagnant' ELSE 'transit' END), 1, 8) AS alert_id,
        CASE WHEN track_id % 10 = 0 THEN 'stagnant' ELSE 'transit' END AS type, channel_id AS channel, CAST(track_id AS VARCHAR) AS track_id,
        min_by(class_name, frame) AS class_name, min(frame) AS first_seen_frame, max(frame) AS last_seen_frame, min(pts_ms) AS first_pts,
        max(pts_ms) AS last_pts, CASE WHEN count(*) >= 2 AND max(pts_ms) > min(pts_ms) THEN max(pts_ms) - min(pts_ms)
            ELSE CAST(trunc((max(frame) - min(frame)) / 30.0 * 1000) AS BIGINT) END AS duration_ms,
        round(avg(confidence), 2) AS avg_confidence, round(max(confidence), 2) AS max_confidence, count(*) AS frames_tracked,
        max(frame) * 1000000 + track_id AS seq FROM det GROUP BY channel_id, det.track_id)"""


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.from_tracks(det(spark, sf_dir))


SUMMARY = (
    "alert_id, type, channel, track_id, class_name, first_seen_frame, last_seen_frame, first_pts, last_pts, duration_ms, avg_confidence,"
    " max_confidence, frames_tracked, CAST(0 AS INT) AS frames_stationary, seq"
)


@query(f"{ALERTS} SELECT {SUMMARY} FROM alerts ORDER BY seq DESC LIMIT 50")
def alert_summary_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.read(base(spark, sf_dir))


@query(f"{ALERTS} SELECT {SUMMARY} FROM alerts WHERE type = 'transit' AND channel = 1 ORDER BY seq DESC LIMIT 200")
def alert_read_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.read(base(spark, sf_dir), 200, "transit", 1)


@query(f"{ALERTS} SELECT channel, type, count(*) AS n FROM alerts GROUP BY ALL")
def alert_counts_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).groupBy("channel", "type").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"{ALERTS}, n AS (SELECT channel, count(*) AS alerts, count(*) FILTER (type = 'transit') AS transits FROM alerts WHERE channel <> 2 GROUP BY ALL)"
    " SELECT c.channel, coalesce(alerts, 0) AS alerts, coalesce(transits, 0) AS transits FROM (SELECT range AS channel FROM range(4)) c LEFT JOIN n USING (channel)"
)
def channel_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels with what they have; one is cleared, one never had any."""
    kept = alerts.without_channel(base(spark, sf_dir), 2)
    n = kept.groupBy("channel").agg(F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("type") == "transit").alias("transits"))
    listed = spark.range(4).withColumnRenamed("id", "channel").join(n, "channel", "left")
    return listed.select("channel", F.coalesce("alerts", F.lit(0)).alias("alerts"), F.coalesce("transits", F.lit(0)).alias("transits"))


@query(
    f"{ALERTS}, m AS (SELECT seq, CASE WHEN seq % 7 = 0 THEN NULL ELSE channel END AS channel, CASE WHEN seq % 11 = 0 THEN NULL ELSE type END AS type FROM alerts)"
    " SELECT * FROM m WHERE (channel IS NULL OR channel IN (0, 1)) AND (type IS NULL OR type IN ('stagnant'))"
)
def ws_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = base(spark, sf_dir).select(
        "seq", F.when(F.col("seq") % 7 != 0, F.col("channel")).alias("channel"), F.when(F.col("seq") % 11 != 0, F.col("type")).alias("type")
    )
    return alerts.delivered(messages, [0, 1], ["stagnant"])


@query(
    f"{ALERTS}, r AS (SELECT channel, seq, row_number() OVER (PARTITION BY channel ORDER BY seq DESC) AS r FROM alerts) SELECT channel, seq FROM r WHERE r <= 20"
)
def bounded_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.queued(base(spark, sf_dir).select("channel", "seq"), 20)


@query(
    f"{ALERTS}, live AS (SELECT alert_id, seq, 'live' AS src FROM alerts WHERE seq % 3 <> 0), old AS (SELECT alert_id, seq, 'backfill' AS src FROM alerts"
    " WHERE seq % 2 = 0) SELECT * FROM live UNION ALL SELECT * FROM old WHERE alert_id NOT IN (SELECT alert_id FROM live)"
)
def alert_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = base(spark, sf_dir).select("alert_id", "seq")
    live, old = own.where("seq % 3 <> 0"), own.where("seq % 2 = 0")
    return alerts.merged(live.withColumn("src", F.lit("live")), old.withColumn("src", F.lit("backfill")))


@query(
    f"{ALERTS} SELECT alert_id, greatest(0.0, first_pts / 1000 - 1.0) AS start_s, last_pts / 1000 + 0.5 AS end_s, (first_pts + last_pts) / 2 / 1000 AS still_s FROM alerts"
)
def clip_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end, still = alerts.clip_window(F.col("first_pts"), F.col("last_pts"))
    return base(spark, sf_dir).select("alert_id", start.alias("start_s"), end.alias("end_s"), still.alias("still_s"))


@query(
    f"WITH {D.DET_SQL}, asked AS (SELECT channel_id, track_id, min(pts_ms) + k.range * 400 AS t, k.range AS k FROM det, range(8) k GROUP BY channel_id, track_id, k.range)"
    " SELECT a.channel_id, a.track_id, a.k, coalesce(min(d.frame) FILTER (d.pts_ms >= a.t), max(d.frame)) AS frame"
    " FROM asked a JOIN det d USING (channel_id, track_id) GROUP BY ALL"
)
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For eight moments of each track, its first row at or after the moment, or its last: one pass over a union, no join."""
    rows = det(spark, sf_dir).select("channel_id", "track_id", "pts_ms", "frame")
    first = rows.groupBy("channel_id", "track_id").agg(F.min("pts_ms").alias("t0"))
    asked = first.select("channel_id", "track_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"), "t0")
    asked = asked.select("channel_id", "track_id", F.col("k").cast("long").alias("k"), (F.col("t0") + F.col("k") * 400).alias("pts_ms"))
    return sequences.asof_forward(asked, rows, ["channel_id", "track_id"], "pts_ms", "frame", "k")


@query(
    "SELECT event_type AS channel, CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, count(*) AS n, round(avg(value), 8) AS avg_value, max_by(value, ts) AS last_value"
    " FROM events GROUP BY ALL"
)
def stats_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.tumbling(D.read_events(spark, sf_dir), "ts", "1 day", "event_type", "value")


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events),"
    " s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)"
    " SELECT user_id, min(ts) AS start, max(ts) AS last_seen, count(*) AS n FROM s GROUP BY user_id, k"
)
def session_watchdog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.watchdog(D.read_events(spark, sf_dir), "user_id", "ts", "12 hours")


@query(
    "SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86399999999 MICROSECONDS PRECEDING AND CURRENT ROW) >= 3 AS tripped FROM events"
)
def breaker_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.breaker(D.read_events(spark, sf_dir), "user_id", "ts", 86400, 3).select("user_id", "event_id", "tripped")


FRAMES = f"""WITH RECURSIVE {D.DET_SQL}, own AS (SELECT channel_id, frame, frame * 16 AS pts, row_number() OVER (PARTITION BY channel_id ORDER BY frame) AS n
    FROM (SELECT DISTINCT channel_id, frame FROM det)),"""


@query(
    f"{FRAMES} kept AS (SELECT channel_id, n, frame, pts AS last, TRUE AS keep FROM own WHERE n = 1 UNION ALL"
    " SELECT o.channel_id, o.n, o.frame, CASE WHEN o.pts - k.last >= 1000.0 / 30 - 1 THEN o.pts ELSE k.last END, o.pts - k.last >= 1000.0 / 30 - 1"
    " FROM kept k JOIN own o ON o.channel_id = k.channel_id AND o.n = k.n + 1) SELECT channel_id, frame FROM kept WHERE keep"
)
def rate_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = det(spark, sf_dir).select("channel_id", "frame", (F.col("frame") * 16).alias("pts_ms")).distinct()
    return sequences.rate_cap(frames, "channel_id", "pts_ms", 30.0).select("channel_id", "frame")


@query(
    f"WITH {D.FRAGMENTED_SQL}, seen AS (SELECT DISTINCT track_id // 10 AS channel_id, frame FROM det), ends AS (SELECT channel_id, min(frame) AS a, max(frame) AS b FROM seen GROUP BY ALL),"
    " f AS (SELECT e.channel_id, r.frame, s.frame IS NULL AS empty FROM ends e, unnest(range(a, b + 1)) AS r(frame) LEFT JOIN seen s ON s.channel_id = e.channel_id AND s.frame = r.frame),"
    " g AS (SELECT *, sum(CASE WHEN empty THEN 0 ELSE 1 END) OVER (PARTITION BY channel_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS k FROM f),"
    " s AS (SELECT *, CASE WHEN empty THEN sum(CASE WHEN empty THEN 1 ELSE 0 END) OVER (PARTITION BY channel_id, k ORDER BY frame ROWS UNBOUNDED PRECEDING) ELSE 0 END AS streak FROM g)"
    " SELECT channel_id, frame, streak > 30 AS idle, CASE WHEN streak > 30 THEN 15 ELSE 1 END AS every FROM s"
)
def idle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames of cameras that see one vehicle each, in fragments: the frames between these are empty."""
    seen = det(spark, sf_dir, piece=30).select(F.expr("track_id div 10").alias("channel_id"), "frame", F.lit(False).alias("empty")).distinct()
    ends = seen.groupBy("channel_id").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    frames = ends.select("channel_id", F.explode(F.sequence("a", "b")).alias("frame")).join(seen, ["channel_id", "frame"], "left")
    return sequences.idle(frames.withColumn("empty", F.coalesce("empty", F.lit(True)))).select("channel_id", "frame", "idle", "every")


@query(
    f"WITH {D.DET_SQL}, n AS (SELECT channel_id, round(10 + w * h / 200.0, 1) AS ms, row_number() OVER (PARTITION BY channel_id ORDER BY round(10 + w * h / 200.0, 1)) - 1 AS r,"
    " count(*) OVER (PARTITION BY channel_id) AS n FROM det) SELECT channel_id, round(avg(ms), 3) AS mean, min(ms) AS least, max(ms) AS most,"
    " max(ms) FILTER (r = n // 2) AS p50, max(ms) FILTER (r = CAST(floor(n * 0.99) AS BIGINT)) AS p99, max(ms) FILTER (r = greatest(0, CAST(floor(n * 0.95) AS BIGINT) - 1)) AS p95 FROM n GROUP BY ALL"
)
def index_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = det(spark, sf_dir).select("channel_id", F.round(10 + F.col("w") * F.col("h") / 200.0, 1).alias("ms"))
    return sequences.index_percentiles(ms, "channel_id", "ms")


@query(
    f"{ALERTS} SELECT alert_id, CASE WHEN avg_confidence * 20 < 5 THEN 'red' WHEN avg_confidence * 20 < 15 THEN 'amber' ELSE 'green' END AS fps,"
    " CASE WHEN duration_ms / 50 > 40 THEN 'red' WHEN duration_ms / 50 > 20 THEN 'amber' ELSE 'green' END AS latency,"
    " CASE WHEN seq % 200000 < 60 THEN 'just now' WHEN seq % 200000 < 3600 THEN (seq % 200000 // 60) || 'm ago' WHEN seq % 200000 < 86400 THEN (seq % 200000 // 3600) || 'h ago'"
    " ELSE (seq % 200000 // 86400) || 'd ago' END AS age FROM alerts"
)
def display_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select(
        "alert_id", alerts.fps_level(F.col("avg_confidence") * 20).alias("fps"), alerts.latency_level(F.col("duration_ms") / 50).alias("latency"),
        alerts.age_text(F.col("seq") % 200000).alias("age"),
    )


@query(f"{ALERTS} SELECT a.alert_id, seq, row_number() OVER (PARTITION BY channel ORDER BY seq DESC) AS number FROM alerts a")
def newest_first_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = Window.partitionBy("channel").orderBy(F.desc("seq"))
    return base(spark, sf_dir).select("alert_id", "seq", F.row_number().over(newest).cast("long").alias("number"))


@query(
    f"WITH {D.DET_SQL}, f AS (SELECT channel_id, frame, max(pts_ms) AS pts_ms, list({{'id': CAST(track_id AS VARCHAR), 'class': class_name, 'bbox': [x, y, w, h], 'confidence': round(confidence, 3),"
    " 'centroid': [cx, cy]} ORDER BY CAST(track_id AS VARCHAR)) AS tracks FROM det GROUP BY ALL) SELECT channel_id, frame,"
    " to_json({'type': 'frame_data', 'channel': channel_id, 'frame': frame, 'pts_ms': pts_ms, 'tracks': tracks})::VARCHAR AS message FROM f"
)
def frame_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.frame_messages(det(spark, sf_dir))
