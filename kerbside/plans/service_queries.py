"""Reads by id and channel, settings, display texts and figures of runs, each with its SQL equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions import geometry as G
from kerbside.operators import alerts, curation, tracks
from kerbside.plans.alert_queries import ALERTS, base
from kerbside.plans.live_queries import STATES, states
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


@query(f"WITH {D.DET_SQL} SELECT channel_id, class_name, count(*) AS n FROM det WHERE class_name IN ('click', 'purchase') GROUP BY ALL")
def class_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = tracks.of_classes(det(spark, sf_dir), ["click", "purchase"])
    return kept.groupBy("channel_id", "class_name").agg(F.count(F.lit(1)).alias("n"))


WHOLE = """whole AS (
    SELECT a.alert_id, a.channel, a.type, string_agg(d.cx || ':' || d.cy || ':' || d.frame, ',' ORDER BY d.frame) AS path, count(*) AS points
    FROM alerts a JOIN det d ON CAST(d.track_id AS VARCHAR) = a.track_id AND d.channel_id = a.channel GROUP BY ALL)"""


def _whole(found: DataFrame) -> DataFrame:
    point = lambda p: F.concat_ws(":", p["x"], p["y"], p["frame"])
    path = F.array_join(F.transform("full_trajectory", point), ",")
    return found.select("alert_id", "channel", "type", path.alias("path"), F.size("full_trajectory").cast("long").alias("points"))


@query(f"{ALERTS}, {WHOLE} SELECT * FROM whole WHERE alert_id IN (SELECT min(alert_id) FROM alerts GROUP BY channel)")
def alert_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole alerts looked up by id: the least id of each channel."""
    own = base(spark, sf_dir)
    return _whole(alerts.by_ids(own, own.groupBy("channel").agg(F.min("alert_id").alias("alert_id"))))


@query(f"{ALERTS}, {WHOLE} SELECT * FROM whole WHERE channel = 1")
def channel_alerts_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(alerts.of_channel(base(spark, sf_dir), 1))


@query(f"{ALERTS} SELECT count(*) AS \"all\", count(*) FILTER (type = 'transit') AS transit, count(*) FILTER (type = 'stagnant') AS stagnant FROM alerts")
def alert_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.tabs(base(spark, sf_dir))


@query(
    f"{STATES}{ALERTS.removeprefix(f'WITH {D.DET_SQL}')} SELECT alert_id, channel, phase, source, CASE WHEN phase = 'review' THEN 'now' WHEN phase IS NULL THEN 'waits' ELSE 'at the end' END AS clip"
    " FROM alerts LEFT JOIN states USING (channel)"
)
def late_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts with the phase and source that their channel has after all commands, and when their clip is cut."""
    found = alerts.with_channel_state(base(spark, sf_dir), states(det(spark, sf_dir)))
    return found.select("alert_id", "channel", "phase", "source", "clip")


@query(
    f"WITH {D.DET_SQL}, s AS (SELECT n_nationkey AS channel_id, n_regionkey / 5.0::DOUBLE AS threshold FROM nation WHERE n_nationkey % 3 <> 1) SELECT channel_id, count(*) AS n FROM det LEFT JOIN s USING (channel_id)"
    " WHERE confidence > coalesce(threshold, 0.25::DOUBLE) GROUP BY ALL"
)
def channel_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes above the threshold of their channel; settings are rows of a table, and some channels have none."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey % 3 <> 1")
    settings = nations.select(F.col("n_nationkey").cast("long").alias("channel_id"), (F.col("n_regionkey") / F.lit(5.0)).alias("threshold"))
    return tracks.above_thresholds(det(spark, sf_dir), settings).groupBy("channel_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {D.DET_SQL}, s(source_id, channel) AS (VALUES (0, 'a'), (1, 'b'), (7, 'c')) SELECT channel, frame, count(*) AS n FROM det JOIN s ON source_id = track_id % 8 GROUP BY ALL"
)
def batch_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by the channel of their source; sources that nobody knows are dropped."""
    frames = det(spark, sf_dir).select((F.col("track_id") % 8).alias("source_id"), "frame")
    known = spark.createDataFrame([(0, "a"), (1, "b"), (7, "c")], "source_id long, channel string")
    return tracks.dispatched(frames, known).groupBy("channel", "frame").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {D.DET_SQL} SELECT channel_id, max(frame) AS frame FROM (SELECT channel_id, frame FROM det GROUP BY ALL HAVING max(confidence) < 0.9) GROUP BY ALL")
def last_clean_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last frame of each channel on which nothing is drawn."""
    frames = det(spark, sf_dir).groupBy("channel_id", "frame").agg(F.max("confidence").alias("best"))
    return frames.where("best < 0.9").groupBy("channel_id").agg(F.max("frame").alias("frame"))


ARM = "CASE WHEN seq % 5 = 0 THEN NULL ELSE class_name END"


@query(
    f"{ALERTS} SELECT alert_id, CASE WHEN type = 'transit' THEN upper(substr(coalesce({ARM}, '?'), 1, 1)) || ' ↣ ' || upper(substr(class_name, 1, 1)) ELSE 'Stagnant' END AS direction,"
    " CASE WHEN seq % 3 = 0 THEN printf('%.1fs', frames_tracked / 30.0::DOUBLE) WHEN type = 'transit' THEN printf('%.1fs', CASE WHEN duration_ms % 500 = 250 THEN floor(duration_ms / 100.0::DOUBLE + 0.5) / 10 ELSE duration_ms / 1000.0::DOUBLE END)"
    " WHEN seq % 2 = 0 THEN '' ELSE CAST(floor(duration_ms / 1000.0::DOUBLE + 0.5) AS BIGINT) || 's' END AS duration FROM alerts"
)
def alert_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = base(spark, sf_dir)
    entry = F.when(F.col("seq") % 5 != 0, F.col("class_name"))
    frames = F.when(F.col("seq") % 3 == 0, F.col("frames_tracked"))
    still = F.when(F.col("seq") % 2 != 0, F.col("duration_ms"))
    duration = alerts.duration_text(F.col("type"), frames, F.col("duration_ms"), F.lit(None).cast("long"), still)
    return own.select("alert_id", alerts.direction_text(F.col("type"), entry, F.col("class_name")).alias("direction"), duration.alias("duration"))


@query(
    f"WITH {D.DET_SQL}, s AS (SELECT det_ord, cx, cy, least(960.0::DOUBLE / 1920, 700.0::DOUBLE / 1080) AS s FROM det), p AS (SELECT *, (cx - (960 - 1920 * s) / 2) / s AS ix, (cy - (700 - 1080 * s) / 2) / s AS iy FROM s),"
    " i AS (SELECT *, ix BETWEEN 0 AND 1920 AND iy BETWEEN 0 AND 1080 AS inside FROM p) SELECT det_ord, CASE WHEN inside THEN round(ix, 6) END AS image_x, CASE WHEN inside THEN round(iy, 6) END AS image_y,"
    " round(cx * s + (960 - 1920 * s) / 2, 6) AS shown_x, round(cy * s + (700 - 1080 * s) / 2, 6) AS shown_y, det_ord % 5 >= 3 AND sqrt((cx - 400)::DOUBLE ** 2 + (cy - 400)::DOUBLE ** 2) < 120 AS closes FROM i"
)
def display_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks on a picture shown whole in a box of 960 by 700, back, and whether they close a polygon begun at (400, 400)."""
    x, y = F.col("cx"), F.col("cy")
    image, shown = (F.lit(1920), F.lit(1080)), (F.lit(960), F.lit(700))
    ix, iy = G.contain_fit(x, y, image, shown)
    sx, sy = G.contain_fit_back(x, y, image, shown)
    return det(spark, sf_dir).select(
        "det_ord", F.round(ix, 6).alias("image_x"), F.round(iy, 6).alias("image_y"), F.round(sx, 6).alias("shown_x"), F.round(sy, 6).alias("shown_y"),
        G.closes(x, y, F.lit(400), F.lit(400), F.col("det_ord") % 5, 120.0).alias("closes"),
    )


@query(f"WITH {D.DET_SQL} SELECT track_id, round(avg(cx), 6) AS x, round(avg(cy), 6) AS y FROM det GROUP BY ALL")
def polygon_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the corners, of the polygon that each track's points make."""
    return det(spark, sf_dir).groupBy("track_id").agg(F.round(F.avg("cx"), 6).alias("x"), F.round(F.avg("cy"), 6).alias("y"))


@query(
    "SELECT event_id, event_id * 3003 * 1000 // 90000 AS pts_ms, (event_id * 33366667 + 999999) // 1000000 AS clock_ms, CAST(trunc(value * 3 - 700) AS BIGINT) AS cut,"
    " CASE event_type WHEN 'click' THEN 'car' WHEN 'view' THEN 'bus' ELSE 'vehicle' END AS label FROM events"
)
def clock_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of 90 kHz and nanoseconds to whole milliseconds, pixels cut towards zero, and a lookup with a default."""
    names = F.create_map(*[F.lit(x) for x in ("click", "car", "view", "bus")])
    return D.read_events(spark, sf_dir).select(
        "event_id", F.expr("event_id * 3003 * 1000 div 90000").alias("pts_ms"), F.expr("(event_id * 33366667 + 999999) div 1000000").alias("clock_ms"),
        (F.col("value") * 3 - 700).cast("long").alias("cut"), F.coalesce(F.try_element_at(names, F.col("event_type")), F.lit("vehicle")).alias("label"),
    )


@query("SELECT user_id, string_agg(event_type || '=' || last, ',' ORDER BY event_type) AS lines FROM (SELECT user_id, event_type, max_by(event_id, ts) AS last FROM events GROUP BY ALL) GROUP BY ALL")
def lines_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of labelled lines as a map and back; of lines with one label the last wins."""
    last = D.read_events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.max_by("event_id", "ts").alias("line"))
    maps = last.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "line"))).alias("m"))
    entry = lambda e: F.concat_ws("=", e["key"], e["value"])
    return maps.select("user_id", F.array_join(F.transform(F.sort_array(F.map_entries("m")), entry), ",").alias("lines"))


@query("SELECT event_type, round(avg(value), 1) AS mean, round(max(value), 1) AS peak FROM events GROUP BY ALL")
def resource_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.peaks(D.read_events(spark, sf_dir), "event_type", "value")


@query(
    "WITH p AS (SELECT source, doc_id % 5 AS k, count(*) AS v FROM documents GROUP BY ALL), t AS (SELECT k, sum(v)::BIGINT AS v FROM p GROUP BY ALL) SELECT list(v ORDER BY k) AS counts FROM t"
)
def totals_of_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of all sites, arrays of five counts, added up."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = F.array(*[F.count_if(F.col("doc_id") % 5 == k) for k in range(5)])
    return curation.summed_arrays(docs.groupBy("source").agg(counts.alias("counts")), "counts")


@query(
    "WITH RECURSIVE e AS (SELECT vec_id // 8 AS track, row_number() OVER (PARTITION BY vec_id // 8 ORDER BY vec_id) AS k, embedding::DOUBLE[] AS f FROM embeddings),"
    " u AS (SELECT track, k, list_transform(f, lambda v: v / sqrt(list_dot_product(f, f))) AS f FROM e),"
    " s AS (SELECT track, k, f AS g FROM u WHERE k = 1 UNION ALL SELECT track, k, list_transform(m, lambda v: v / sqrt(list_dot_product(m, m))) FROM (SELECT u.track, u.k,"
    " list_transform(list_zip(s.g, u.f), lambda z: z[1] * 0.9::DOUBLE + z[2] * (1 - 0.9::DOUBLE)) AS m FROM s JOIN u ON u.track = s.track AND u.k = s.k + 1)),"
    " l AS (SELECT track, max_by(g, k) AS g FROM s GROUP BY ALL) SELECT track, round(g[1], 5) AS first, round(g[64], 5) AS last, round(list_sum(g), 5) AS total FROM l"
)
def smoothed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight sightings of each of these tracks."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.expr("vec_id div 8").alias("track"), "vec_id", "embedding")
    found = curation.smoothed(rows, ["track"], "vec_id", "embedding")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v)
    at = lambda k: F.round(F.get("embedding", F.lit(k)), 5)
    return found.select("track", at(0).alias("first"), at(63).alias("last"), F.round(total, 5).alias("total"))


@query(
    f"WITH {D.DET_SQL}, f AS (SELECT channel_id, count(DISTINCT frame) AS frames, count(*) AS boxes, count(DISTINCT track_id) AS tracks FROM det GROUP BY ALL)"
    " SELECT channel_id, to_json({'channel_id': channel_id, 'frames': frames, 'boxes': boxes, 'tracks': tracks})::VARCHAR AS body,"
    " printf('%-8d %8d %10s %+d', channel_id, frames, format('{:,}', boxes), tracks - 50) AS line FROM f"
)
def comparison_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of each channel as JSON and as a line of fixed width, with separators and a signed difference."""
    figures = det(spark, sf_dir).groupBy("channel_id").agg(
        F.countDistinct("frame").alias("frames"), F.count(F.lit(1)).alias("boxes"), F.countDistinct("track_id").alias("tracks")
    )
    body = F.to_json(F.struct("channel_id", "frames", "boxes", "tracks"))
    line = F.format_string("%-8d %8d %10s %+d", "channel_id", "frames", F.format_string("%,d", "boxes"), F.col("tracks") - 50)
    return figures.select("channel_id", body.alias("body"), line.alias("line"))


@query(
    "WITH l AS (SELECT user_id, max_by(event_type, ts) AS state, count(*) AS n FROM events GROUP BY ALL)"
    " SELECT state, count(*) AS jobs, CAST(sum(n) AS BIGINT) AS reports, count(*) FILTER (n > 60) AS slow FROM l GROUP BY ALL"
)
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of each clip job, from all that jobs have reported."""
    latest = D.read_events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_type", "ts").alias("state"), F.count(F.lit(1)).alias("n"))
    return latest.groupBy("state").agg(F.count(F.lit(1)).alias("jobs"), F.sum("n").alias("reports"), F.count_if(F.col("n") > 60).alias("slow"))


@query(
    f"WITH {D.DET_SQL} SELECT class_name, count(*) AS n, min(confidence) AS least, max(confidence) AS most, count(*) >= 1 AND max(confidence) > 0.5 AS passed FROM det GROUP BY ALL"
)
def smoke_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = det(spark, sf_dir).groupBy("class_name").agg(F.count(F.lit(1)).alias("n"), F.min("confidence").alias("least"), F.max("confidence").alias("most"))
    return by.withColumn("passed", (F.col("n") >= 1) & (F.col("most") > 0.5))
