"""What the service answers to every request that could be made of it, and how teachers compare, each with its SQL equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators import comparison, control, service, tracks
from kerbside.plans.alert_queries import ALERTS, base
from kerbside.plans.curation_queries import BOXES, IOU, scenes
from kerbside.plans.live_queries import COMMANDS, STATES, site_commands, states
from kerbside.plans.track_queries import IN_ROI, det
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


#: A picture's sides, in which these boxes lie.
WIDE, TALL = 360, 260
#: When the service is asked, on the clock of the video.
NOW_MS = 2500


def teachers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A plan of all pictures, and what three teachers predicted of them: all boxes; shifted ones of most pictures; confident ones alone."""
    own = scenes(spark, sf_dir).select(
        F.concat(F.lit("site"), "channel_id").alias("site"), F.concat(F.lit("f"), "pic").alias("stem"), "pic", "box", *[F.col(c) for c in ("x1", "y1", "x2", "y2", "score")])
    plan = own.select("site", "stem").distinct()
    moved = own.where("pic % 7 <> 3").withColumns({c: F.col(c) + F.col("box") % 9 for c in ("x1", "x2")}).withColumn("kept", F.col("box") % 5 != 0)
    sure = own.withColumn("kept", F.col("score") > 0.9)
    each = [("base", own.withColumn("kept", F.lit(True))), ("shifted", moved), ("sure", sure)]
    corners = ["x1", "y1", "x2", "y2", "score"]
    rows = None
    for name, df in each:
        part = df.select(F.lit(name).alias("teacher"), "site", "stem", *[F.when(F.col("kept"), F.col(c)).alias(c) for c in ("box", *corners)])
        rows = part if rows is None else rows.unionByName(part)
    return plan, rows


_HIST = lambda v, bounds: " || ',' || ".join(
    f"count(*) FILTER ({v} >= {lo} AND {v} {'<=' if k == len(bounds) - 2 else '<'} {hi})" for k, (lo, hi) in enumerate(zip(bounds, bounds[1:])))
TEACHERS = f"""{BOXES}, named AS (SELECT 'site' || channel_id AS site, 'f' || pic AS stem, pic, box, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2, score FROM boxes),
raw AS (
    SELECT 'base' AS teacher, *, TRUE AS kept FROM named UNION ALL SELECT 'shifted', * REPLACE (x1 + box % 9 AS x1, x2 + box % 9 AS x2), box % 5 <> 0 FROM named WHERE pic % 7 <> 3
    UNION ALL SELECT 'sure', *, score > 0.9::DOUBLE FROM named),
plan AS (SELECT DISTINCT site, stem FROM named),
made AS (SELECT teacher, site, stem, count(*) FILTER (kept) AS n FROM raw GROUP BY ALL),
frames AS (SELECT t.teacher, p.site, p.stem, m.n FROM plan p CROSS JOIN (SELECT DISTINCT teacher FROM raw) t LEFT JOIN made m ON m.teacher = t.teacher AND m.site = p.site AND m.stem = p.stem),
totals AS (
    SELECT teacher, CAST(coalesce(sum(n), 0) AS BIGINT) AS total, count(*) FILTER (n > 0) AS with_boxes, count(*) FILTER (n = 0) AS empty, count(*) FILTER (n IS NULL) AS missing,
        round(avg(n), 2) AS mean, CAST(trunc(median(n)) AS INT) AS median, CAST(trunc(quantile_cont(n, 0.9)) AS INT) AS p90, max(n) AS most FROM frames GROUP BY ALL),
sites AS (
    SELECT teacher, string_agg(site || ':' || total || '/' || frames || '=' || round(total / frames, 2), ' ' ORDER BY site || ':') AS sites
    FROM (SELECT teacher, site, CAST(sum(n) AS BIGINT) AS total, count(*) AS frames FROM frames WHERE n IS NOT NULL GROUP BY ALL) GROUP BY ALL),
shapes AS (
    SELECT teacher, {_HIST(f"((x2 - x1) * (y2 - y1) / ({WIDE} * {TALL}) * 100)", comparison.AREAS)} AS areas, {_HIST("((x2 - x1) / (y2 - y1))", comparison.ASPECTS)} AS aspects,
        round(avg(score), 3) AS mean_conf FROM raw WHERE kept GROUP BY ALL),
shared AS (SELECT c.teacher, c.site, c.stem FROM made c JOIN made b ON b.teacher = 'base' AND b.site = c.site AND b.stem = c.stem WHERE c.teacher <> 'base'),
cand AS (SELECT r.* FROM raw r JOIN shared s ON s.teacher = r.teacher AND s.site = r.site AND s.stem = r.stem WHERE r.kept),
basis AS (SELECT s.teacher, r.site, r.stem, r.box, r.x1, r.y1, r.x2, r.y2 FROM raw r JOIN shared s ON s.site = r.site AND s.stem = r.stem WHERE r.teacher = 'base'),
near AS (SELECT a.teacher, a.site, a.stem, a.box AS box_a, b.box AS box_b, {IOU} AS iou FROM cand a JOIN basis b ON a.teacher = b.teacher AND a.site = b.site AND a.stem = b.stem),
r AS (SELECT *, row_number() OVER (PARTITION BY teacher, site, stem ORDER BY iou DESC, box_a DESC, box_b DESC) AS k FROM near WHERE iou >= 0.5),
kept AS (
    SELECT teacher, site, stem, k, 1 AS n, [box_a] AS a, [box_b] AS b FROM r WHERE k = 1 UNION ALL SELECT s.teacher, s.site, s.stem, q.k,
        s.n + CASE WHEN list_contains(s.a, q.box_a) OR list_contains(s.b, q.box_b) THEN 0 ELSE 1 END,
        CASE WHEN list_contains(s.a, q.box_a) OR list_contains(s.b, q.box_b) THEN s.a ELSE list_append(s.a, q.box_a) END,
        CASE WHEN list_contains(s.a, q.box_a) OR list_contains(s.b, q.box_b) THEN s.b ELSE list_append(s.b, q.box_b) END
    FROM kept s JOIN r q ON q.teacher = s.teacher AND q.site = s.site AND q.stem = s.stem AND q.k = s.k + 1),
hits AS (SELECT teacher, CAST(sum(n) AS BIGINT) AS matched FROM (SELECT teacher, site, stem, max(n) AS n FROM kept GROUP BY ALL) GROUP BY ALL),
pairs AS (
    SELECT s.teacher, coalesce(any_value(matched), 0) AS matched, coalesce(any_value(c.n), 0) AS candidate, coalesce(any_value(b.n), 0) AS baseline FROM (SELECT DISTINCT teacher FROM shared) s LEFT JOIN hits USING (teacher)
    LEFT JOIN (SELECT teacher, count(*) AS n FROM cand GROUP BY ALL) c USING (teacher) LEFT JOIN (SELECT teacher, count(*) AS n FROM basis GROUP BY ALL) b USING (teacher) GROUP BY ALL)"""


@query(
    f"{TEACHERS} SELECT t.*, sites, areas, aspects, coalesce(mean_conf, 0) AS mean_conf, matched, round(matched / greatest(baseline, 1), 3) AS rate, candidate - matched AS extra, baseline - matched AS missed, baseline, candidate,"
    " printf('%-20s %8d %10s %10s', t.teacher, total, mean::VARCHAR, coalesce(mean_conf, 0)::DOUBLE::VARCHAR) AS line FROM totals t LEFT JOIN sites USING (teacher) LEFT JOIN shapes USING (teacher) LEFT JOIN pairs USING (teacher)"
)
def teacher_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three teachers: totals, sites, histograms, agreement with the first one, and a line of text each."""
    return comparison.dashboard(*teachers(spark, sf_dir), "base", WIDE, TALL)


def clip_jobs(alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A clip job for each alert, submitted when its vehicle has left, and the cleaning up of every third channel half a second after its last one."""
    jobs = alerts.select(
        "alert_id", "channel", F.col("last_pts").alias("submitted_ms"), (F.col("last_pts") + 100 + F.col("seq") % 7000).alias("finished_ms"), (F.col("seq") % 11 == 0).alias("failed"))
    return jobs, jobs.where("channel % 3 = 2").groupBy("channel").agg((F.max("submitted_ms") - 1000).alias("at_ms"))


JOBS = f"""{ALERTS}, jobs AS (SELECT alert_id, channel, last_pts AS submitted_ms, last_pts + 100 + seq % 7000 AS finished_ms, seq % 11 = 0 AS failed FROM alerts),
cleanups AS (SELECT channel, max(submitted_ms) - 1000 AS at_ms FROM jobs WHERE channel % 3 = 2 GROUP BY ALL HAVING max(submitted_ms) - 1000 <= {NOW_MS}),
status AS (
    SELECT alert_id, CASE WHEN at_ms IS NULL THEN CASE WHEN finished_ms > {NOW_MS} THEN 'pending' WHEN failed THEN 'failed' ELSE 'ready' END END AS state,
        CASE WHEN at_ms IS NOT NULL THEN finished_ms <= at_ms + {service.DRAIN_MS} END AS drained FROM jobs LEFT JOIN cleanups USING (channel) WHERE submitted_ms <= {NOW_MS})"""


@query(f"{JOBS} SELECT channel, state, drained, count(*) AS n FROM status JOIN jobs USING (alert_id) GROUP BY ALL")
def clip_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, cleanups = clip_jobs(base(spark, sf_dir))
    found = service.job_status(jobs, cleanups, NOW_MS).join(jobs.select("alert_id", "channel"), "alert_id")
    return found.groupBy("channel", "state", "drained").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"{JOBS}, asked AS (SELECT seq AS request_id, alert_id FROM alerts UNION ALL SELECT -seq, 'x' || alert_id FROM alerts WHERE seq % 9 = 0)"
    " SELECT request_id, a.alert_id, CAST(CASE WHEN type IS NULL THEN 404 WHEN state IS NULL OR state = 'pending' THEN 202 WHEN state = 'failed' THEN 500 ELSE 200 END AS INT) AS status,"
    " CASE WHEN type IS NULL THEN 'Alert not found' WHEN state IS NULL THEN 'not_started' WHEN state = 'pending' THEN 'extracting' WHEN state = 'failed' THEN 'Clip extraction failed'"
    " WHEN type = 'stagnant' THEN 'image/jpeg' ELSE 'video/mp4' END AS body FROM asked a LEFT JOIN alerts USING (alert_id) LEFT JOIN status USING (alert_id)"
)
def replay_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replay of every alert, and of some that nobody knows."""
    alerts = base(spark, sf_dir)
    jobs, cleanups = clip_jobs(alerts)
    asked = alerts.select(F.col("seq").alias("request_id"), "alert_id")
    asked = asked.unionByName(alerts.where("seq % 9 = 0").select((-F.col("seq")).alias("request_id"), F.concat(F.lit("x"), "alert_id").alias("alert_id")))
    return service.replays(asked, alerts, service.job_status(jobs, cleanups, NOW_MS))


@query(
    f"{STATES}, asked AS (SELECT DISTINCT track_id AS request_id, track_id % 40 AS channel FROM det), n AS (SELECT channel_id AS channel, count(DISTINCT track_id) AS n FROM det GROUP BY ALL)"
    " SELECT request_id, a.channel, CAST(CASE WHEN phase IS NULL THEN 404 ELSE 200 END AS INT) AS status, source, phase, CASE WHEN phase IS NOT NULL THEN coalesce(n, 0) END AS alert_count"
    " FROM asked a LEFT JOIN states USING (channel) LEFT JOIN n USING (channel)"
)
def channel_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = det(spark, sf_dir)
    asked = rows.select(F.col("track_id").alias("request_id"), (F.col("track_id") % 40).alias("channel")).distinct()
    return service.channels(asked, states(rows), base(spark, sf_dir))


@query(
    f"{STATES}, asked AS (SELECT DISTINCT track_id AS request_id, track_id % 40 AS channel, ['setup', 'analytics', 'review', 'paused'][track_id % 4 + 1] AS phase, track_id % 5 AS corners,"
    " CASE WHEN track_id % 3 = 0 THEN ['a', 'a'] ELSE ['a', 'b'] END AS labels FROM det)"
    " SELECT request_id, CAST(CASE WHEN a.phase = 'paused' THEN 422 WHEN s.phase IS NULL THEN 404 WHEN s.phase = 'setup' AND a.phase = 'analytics' AND (corners < 3 OR labels[1] = labels[2]) THEN 422 ELSE 200 END AS INT) AS status,"
    " CASE WHEN a.phase = 'paused' THEN 'Invalid phase' WHEN s.phase IS NULL THEN 'Channel not found' WHEN s.phase = 'setup' AND a.phase = 'analytics' AND corners < 3"
    " THEN 'ROI polygon with at least 3 vertices required to start analytics' WHEN s.phase = 'setup' AND a.phase = 'analytics' AND labels[1] = labels[2]"
    " THEN 'Duplicate entry/exit line labels are not allowed' END AS detail FROM asked a LEFT JOIN states s USING (channel)"
)
def phase_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = det(spark, sf_dir)
    track, phases = F.col("track_id"), F.array(*[F.lit(p) for p in ("setup", "analytics", "review", "paused")])
    labels = F.when(track % 3 == 0, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    asked = rows.select(track.alias("request_id"), (track % 40).alias("channel"), F.get(phases, (track % 4).cast("int")).alias("phase"), (track % 5).alias("corners"), labels.alias("labels"))
    return service.phase_changes(asked.distinct(), states(rows))


@query(
    f"WITH {D.DET_SQL}, photos AS (SELECT channel_id AS channel, track_id % 100 AS track_id, max('p' || channel_id || '-' || track_id) AS picture, max(frame) AS last FROM det WHERE {IN_ROI} GROUP BY ALL),"
    " ends AS (SELECT channel_id AS channel, max(frame) AS end_ FROM det GROUP BY ALL), p AS (SELECT *, last >= end_ - 10 AS hot FROM photos JOIN ends USING (channel)),"
    " best AS (SELECT track_id, hot, min_by(channel, channel) AS channel, min_by(picture, channel) AS picture FROM p GROUP BY ALL),"
    " asked AS (SELECT event_id AS request_id, CASE WHEN event_id % 7 = 0 THEN 't' || user_id ELSE CAST(user_id AS VARCHAR) END AS track, CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS wanted FROM events)"
    " SELECT request_id, CAST(CASE WHEN wanted IS NULL THEN 400 WHEN coalesce(h.picture, c.picture) IS NULL THEN 404 ELSE 200 END AS INT) AS status, coalesce(h.channel, c.channel) AS channel,"
    " coalesce(h.picture, c.picture) AS picture FROM asked LEFT JOIN best h ON h.hot AND h.track_id = wanted LEFT JOIN best c ON NOT c.hot AND c.track_id = wanted"
)
def snapshot_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The photo of the track that each event asks for: of tracks seen in the last ten frames of a channel, else of those that are over."""
    rows = tracks.with_roi(det(spark, sf_dir), D.ROI)
    name = F.concat(F.lit("p"), F.col("channel_id"), F.lit("-"), F.col("track_id"))
    photos = rows.where("in_roi").groupBy(F.col("channel_id").alias("channel"), (F.col("track_id") % 100).alias("track_id")).agg(F.max(name).alias("picture"), F.max("frame").alias("last"))
    ends = rows.groupBy(F.col("channel_id").alias("channel")).agg(F.max("frame").alias("end_"))
    both = photos.join(ends, "channel").withColumn("hot", F.col("last") >= F.col("end_") - 10)
    asked = D.read_events(spark, sf_dir).select(
        F.col("event_id").alias("request_id"), F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("t"), "user_id")).otherwise(F.col("user_id").cast("string")).alias("track"))
    return service.snapshots(asked, both.where("hot"), both.where("not hot"))


@query(
    f"{COMMANDS}, review AS (SELECT channel_id, pts_ms, command_id FROM spans WHERE phase = 'review' AND old_phase <> 'review' AND action <> 'add'),"
    " seen AS (SELECT d.channel_id, d.pts_ms, d.frame FROM det d JOIN spans s ON d.channel_id = s.channel_id AND d.pts_ms >= s.pts_ms AND (s.until IS NULL OR d.pts_ms < s.until)"
    " WHERE s.phase IN ('setup', 'analytics')), kept AS (SELECT r.channel_id, r.command_id, max(s.frame) AS frame FROM review r LEFT JOIN seen s ON s.channel_id = r.channel_id AND s.pts_ms < r.pts_ms GROUP BY ALL),"
    " last_ AS (SELECT channel_id AS channel, max(frame) AS frame FROM kept WHERE frame IS NOT NULL GROUP BY ALL), asked AS (SELECT DISTINCT track_id AS request_id, track_id % 40 AS channel FROM det)"
    " SELECT request_id, CAST(CASE WHEN frame IS NULL THEN 404 ELSE 200 END AS INT) AS status, frame FROM asked LEFT JOIN last_ USING (channel)"
)
def last_frame_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picture each channel kept at its last change to review; later ones hold later frames."""
    rows = det(spark, sf_dir)
    kept = control.last_before_review(rows.select("channel_id", "pts_ms", "frame"), site_commands(rows))
    asked = rows.select(F.col("track_id").alias("request_id"), (F.col("track_id") % 40).alias("channel")).distinct()
    return service.last_frames(asked, kept.select(F.col("channel_id").alias("channel"), F.col("frame").alias("at"), "frame"))


@query(
    "SELECT page_id AS request_id, CAST(CASE WHEN page_id % 3 = 0 THEN 422 WHEN s_suppkey IS NULL THEN 404 ELSE 200 END AS INT) AS status, CASE WHEN page_id % 3 <> 0 AND s_suppkey IS NOT NULL"
    " THEN CAST(4 AS INT) END AS corners FROM pages LEFT JOIN supplier ON s_suppkey = page_id"
)
def site_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site's document for every page id: some ids are no site's name, some have no document."""
    pages, suppliers = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "supplier"))
    number = F.col("page_id").cast("string")
    asked = pages.select(F.col("page_id").alias("request_id"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("../"), number)).otherwise(F.concat(F.lit("s"), number)).alias("site_id"))
    corners = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in D.ROI])
    return service.sites(asked, suppliers.select(F.concat(F.lit("s"), "s_suppkey").alias("site_id"), corners.alias("roi")))
