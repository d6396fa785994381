"""Queries over the derived detections, each with its SQL equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbside.operators import direction, stitch, tracks
from kerbside.plans.stitch_sql import STITCHED, TRANSITS
from kerbside.sources import detections as D
from kerbside.storage import materialize

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def det(spark: SparkSession, sf_dir: str, **how: int) -> DataFrame:
    return D.detections(D.read_events(spark, sf_dir), **how)


def roi(spark: SparkSession, sf_dir: str, **how: int) -> DataFrame:
    return tracks.with_segments(tracks.with_roi(det(spark, sf_dir, **how), D.ROI))


#: The region is a rectangle; half-open edges make a point on its left or lower side inside, on the others not.
IN_ROI = "(cx >= 250 AND cx < 1650 AND cy >= 150 AND cy < 950)"
SEGMENTED = f"""fresh AS (
    SELECT *, {IN_ROI} AS in_roi, CASE WHEN frame - lag(frame) OVER (PARTITION BY channel_id, track_id ORDER BY frame, det_ord) = 1
        THEN 0 ELSE 1 END AS is_new FROM det),
seg AS (
    SELECT *, track_id * 1000 + sum(is_new) OVER (PARTITION BY channel_id, track_id ORDER BY frame, det_ord
        ROWS UNBOUNDED PRECEDING) AS seg_id FROM fresh)"""
STEPS = """steps AS (
    SELECT *, lag(cx) OVER w AS prev_cx, lag(cy) OVER w AS prev_cy FROM seg
    WINDOW w AS (PARTITION BY channel_id, track_id, seg_id ORDER BY frame, det_ord))"""
CROSSED = """crossed AS (
    SELECT s.*, a.arm_id, a.arm_ord, a.junction_side,
        (a.x2 - a.x1) * (prev_cy - a.y1) - (a.y2 - a.y1) * (prev_cx - a.x1) AS p,
        (a.x2 - a.x1) * (cy - a.y1) - (a.y2 - a.y1) * (cx - a.x1) AS c
    FROM steps s, arms a WHERE prev_cx IS NOT NULL AND in_roi),
crossings AS (
    SELECT channel_id, track_id, CAST(seg_id AS BIGINT) AS seg_id, frame, arm_id, arm_ord, CASE WHEN p < 0 THEN 1 ELSE -1 END AS direction,
        CASE WHEN (p < 0) = (junction_side = 'left') THEN 'entry' ELSE 'exit' END AS kind
    FROM crossed WHERE p::HUGEINT * c < 0)"""
BASE = f"WITH {D.DET_SQL}, {SEGMENTED}, {STEPS}"
ALL_CROSSINGS = f"{BASE}, {D.ARMS_SQL}, {CROSSED}"


@query(f"{ALL_CROSSINGS} SELECT * FROM crossings")
def crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.crossings(roi(spark, sf_dir), D.arms(spark))


@query(f"{ALL_CROSSINGS} SELECT channel_id, arm_id, kind, direction, count(*) AS n FROM crossings GROUP BY ALL")
def crossings_by_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossings(spark, sf_dir).groupBy("channel_id", "arm_id", "kind", "direction").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"{ALL_CROSSINGS}, arm_pairs AS (SELECT channel_id, track_id, min_by(arm_id, frame * 10 + arm_ord) FILTER (kind = 'entry') AS entry_arm,"
    " max_by(arm_id, frame * 10 + arm_ord) FILTER (kind = 'exit') AS exit_arm FROM crossings GROUP BY ALL)"
    " SELECT entry_arm, exit_arm, count(*) AS n FROM arm_pairs GROUP BY ALL"
)
def origin_destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.col("frame") * 10 + F.col("arm_ord")
    entry = F.min_by(F.when(F.col("kind") == "entry", F.col("arm_id")), F.when(F.col("kind") == "entry", rank))
    exit_ = F.max_by(F.when(F.col("kind") == "exit", F.col("arm_id")), F.when(F.col("kind") == "exit", rank))
    ends = crossings(spark, sf_dir).groupBy("channel_id", "track_id").agg(entry.alias("entry_arm"), exit_.alias("exit_arm"))
    return ends.groupBy("entry_arm", "exit_arm").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {D.DET_SQL} SELECT channel_id, {IN_ROI} AS in_roi, count(*) AS n FROM det GROUP BY ALL")
def roi_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.with_roi(det(spark, sf_dir), D.ROI).groupBy("channel_id", "in_roi").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {D.DET_SQL} SELECT channel_id, track_id, min(frame) AS first_frame, max(frame) AS last_frame, max(frame) - min(frame) + 1 AS lifetime,"
    " count(*) AS n_rows, round(avg(confidence), 2) AS avg_confidence, max(confidence) AS max_confidence FROM det GROUP BY ALL"
)
def track_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.lifetimes(det(spark, sf_dir))


@query(
    f"WITH {D.DET_SQL}, scored AS (SELECT *, w * h * confidence AS score FROM det WHERE {IN_ROI}), ranked AS (SELECT *, row_number() OVER"
    " (PARTITION BY channel_id, track_id ORDER BY score DESC, frame, det_ord) AS r FROM scored)"
    " SELECT channel_id, track_id, frame, x, y, w, h, score FROM ranked WHERE r = 1"
)
def best_photo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.best_photo(tracks.with_roi(det(spark, sf_dir), D.ROI))


@query(f"WITH {D.DET_SQL} SELECT channel_id, class_name, count(*) AS n, count(DISTINCT track_id) AS n_tracks FROM det GROUP BY ALL")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det(spark, sf_dir).groupBy("channel_id", "class_name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("track_id").alias("n_tracks"))


MOVED = """moved AS (
    SELECT *, sqrt((cx - lag(cx, 29) OVER o) ** 2 + (cy - lag(cy, 29) OVER o) ** 2) AS displacement FROM steps
    WINDOW o AS (PARTITION BY channel_id, track_id ORDER BY frame, det_ord))"""
RUNS = f"""{MOVED}, looked AS (
    SELECT *, CASE WHEN displacement < 15 THEN 0 ELSE 1 END AS moving FROM moved
    WHERE in_roi AND prev_cx IS NOT NULL AND displacement IS NOT NULL),
runs AS (
    SELECT *, CAST(sum(moving) OVER (PARTITION BY channel_id, track_id ORDER BY frame, det_ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM looked)"""


@query(f"{BASE}, {MOVED} SELECT channel_id, track_id, frame, displacement FROM moved WHERE displacement IS NOT NULL")
def displacement_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = tracks.with_displacement(det(spark, sf_dir))
    return moved.where("displacement is not null").select("channel_id", "track_id", "frame", "displacement")


@query(
    f"{BASE}, {RUNS} SELECT channel_id, track_id, run, min(frame) AS stopped_since, max(frame) AS slow_until, count(*) AS n_rows"
    " FROM runs WHERE moving = 0 GROUP BY ALL"
)
def stop_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.stop_runs(roi(spark, sf_dir))


@query(
    f"{BASE}, {RUNS}, late AS (SELECT *, min(frame) OVER (PARTITION BY channel_id, track_id, run) AS stopped_since FROM runs WHERE moving = 0)"
    " SELECT channel_id, track_id, min(stopped_since) AS stopped_since, min(frame) AS frame FROM late WHERE frame - stopped_since >= 20"
    " GROUP BY channel_id, track_id, run"
)
def stagnant_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a limit that these short tracks can reach."""
    return tracks.stagnations(roi(spark, sf_dir), 20)


@query(
    f"WITH {D.FRAGMENTED_SQL}, fresh AS (SELECT *, {IN_ROI} AS in_roi, CASE WHEN frame - lag(frame) OVER (PARTITION BY channel_id, track_id"
    " ORDER BY frame) = 1 THEN 0 ELSE 1 END AS is_new FROM det), seg AS (SELECT *, CAST(track_id * 1000 + sum(is_new) OVER (PARTITION BY"
    " channel_id, track_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg_id FROM fresh)"
    " SELECT channel_id, track_id, seg_id, min(frame) AS first_frame, max(frame) AS last_frame, max_by(cx, frame) AS last_cx,"
    " max_by(cy, frame) AS last_cy, max_by(in_roi, frame) AS roi_at_end, count(*) AS n_rows FROM seg GROUP BY ALL"
)
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tracks.segments(roi(spark, sf_dir, piece=30))
    return found.select("channel_id", "track_id", "seg_id", "first_frame", "last_frame", "last_cx", "last_cy", "roi_at_end", "n_rows")


@query(f"{STITCHED} SELECT channel_id, prev_seg, seg_id, round(distance, 6) AS distance, gap_frames FROM fates WHERE prev_seg IS NOT NULL")
def stitch_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stitch.stitch(tracks.segments(roi(spark, sf_dir, piece=30)))
    return found.where("prev_seg is not null").select("channel_id", "prev_seg", "seg_id", F.round("distance", 6).alias("distance"), "gap_frames")


@query(f"{STITCHED} SELECT f.channel_id, f.seg_id, r.lineage_id, f.lost_frame, f.final_frame FROM fates f JOIN roots r ON r.channel_id = f.channel_id AND r.seg_id = f.seg_id")
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stitch.stitch(tracks.segments(roi(spark, sf_dir, piece=30))).select("channel_id", "seg_id", "lineage_id", "lost_frame", "final_frame")


@query(f"{TRANSITS} SELECT * FROM transits")
def transit_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return direction.alerts(det(spark, sf_dir, piece=30), D.arms(spark), D.ROI).where("type = 'transit'")


#: Ends of each track's path: where it is taken to stand, and its heading, without what lies outside its jumps.
PATH_ENDS = f"""WITH {D.DET_SQL}, {D.ARMS_SQL}, recent AS (
    SELECT * FROM det QUALIFY row_number() OVER (PARTITION BY channel_id, track_id ORDER BY frame DESC, det_ord DESC) <= 300),
paths AS (
    SELECT channel_id, track_id, list(cx::DOUBLE ORDER BY frame, det_ord) AS xs, list(cy::DOUBLE ORDER BY frame, det_ord) AS ys FROM recent GROUP BY ALL),
jumps AS (
    SELECT *, list_filter(range(1, len(xs)), lambda i: sqrt((xs[i + 1] - xs[i]) ** 2 + (ys[i + 1] - ys[i]) ** 2) > 80) AS gaps FROM paths WHERE len(xs) >= 4),
clean AS (
    SELECT channel_id, track_id, CASE WHEN len(gaps) > 0 AND gaps[-1] - gaps[1] >= 4 THEN xs[gaps[1] + 1:gaps[-1]] ELSE xs END AS xs,
        CASE WHEN len(gaps) > 0 AND gaps[-1] - gaps[1] >= 4 THEN ys[gaps[1] + 1:gaps[-1]] ELSE ys END AS ys FROM jumps),
parts AS (SELECT *, len(xs) AS n, least(5, len(xs) // 2) AS m, len(xs) // 4 AS low, 3 * len(xs) // 4 AS high FROM clean),
leaving AS (
    SELECT *, xs[n] - xs[n - m + 1] AS hx, ys[n] - ys[n - m + 1] AS hy, xs[high + 1] - xs[low + 1] AS sx, ys[high + 1] - ys[low + 1] AS sy FROM parts),
turned AS (
    SELECT *, least(sqrt(hx * hx + hy * hy), sqrt(sx * sx + sy * sy)) >= 1e-9 AND degrees(acos(greatest(-1.0, least(1.0,
        (hx * sx + hy * sy) / nullif(sqrt(hx * hx + hy * hy) * sqrt(sx * sx + sy * sy), 0))))) > 60 AS turn FROM leaving),
ends AS (
    SELECT channel_id, track_id, 'entry' AS side, list_avg(xs[1:m]) AS ox, list_avg(ys[1:m]) AS oy, xs[1] - xs[m] AS hx, ys[1] - ys[m] AS hy FROM parts
    UNION ALL SELECT channel_id, track_id, 'exit', CASE WHEN turn AND m >= 2 THEN list_avg(xs[high - m + 1:high]) ELSE list_avg(xs[n - m + 1:n]) END,
        CASE WHEN turn AND m >= 2 THEN list_avg(ys[high - m + 1:high]) ELSE list_avg(ys[n - m + 1:n]) END, CASE WHEN turn THEN sx ELSE hx END, CASE WHEN turn THEN sy ELSE hy END FROM turned)"""


@query(
    f"{PATH_ENDS}, lines AS (SELECT *, (x2 - x1)::DOUBLE AS dx, (y2 - y1)::DOUBLE AS dy FROM ends, arms), crossed AS (SELECT *, hx * dy - hy * dx AS across,"
    " greatest(0.0, least(1.0, ((ox - x1) * dx + (oy - y1) * dy) / (dx * dx + dy * dy))) AS along FROM lines),"
    " measured AS (SELECT *, CASE WHEN abs(across) >= 1e-12 AND sqrt(hx * hx + hy * hy) > 5 AND ((x1 - ox) * hy - (y1 - oy) * hx) / across BETWEEN 0 AND 1 AND"
    " ((x1 - ox) * dy - (y1 - oy) * dx) / across >= 0 THEN ((x1 - ox) * dy - (y1 - oy) * dx) / across END AS t,"
    " sqrt((ox - x1 - along * dx) ** 2 + (oy - y1 - along * dy) ** 2) AS apart FROM crossed),"
    " best AS (SELECT *, row_number() OVER (PARTITION BY channel_id, track_id, side ORDER BY t NULLS LAST, CASE WHEN t IS NULL THEN apart ELSE 0 END, arm_ord) AS r FROM measured)"
    " SELECT channel_id, track_id, max(arm_id) FILTER (side = 'entry') AS entry_arm, max(arm_id) FILTER (side = 'exit') AS exit_arm FROM best WHERE r = 1 GROUP BY ALL"
)
def path_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each track seems to come from and to go to, by the headings of its ends."""
    recent = Window.partitionBy("channel_id", "track_id").orderBy(F.desc("frame"), F.desc("det_ord"))
    rows = det(spark, sf_dir).withColumn("back", F.row_number().over(recent)).where(F.col("back") <= direction.HISTORY)
    point = F.struct("frame", "det_ord", F.col("cx").cast("double").alias("x"), F.col("cy").cast("double").alias("y"))
    paths = rows.groupBy("channel_id", "track_id").agg(F.sort_array(F.collect_list(point)).alias("path")).where(F.size("path") >= 4)
    paths = paths.withColumn("path", F.transform("path", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    return direction.arms_of_paths(paths, [(a, float(x1), float(y1), float(x2), float(y2)) for a, x1, y1, x2, y2, _ in D.ARMS])


@query(
    f"{TRANSITS}, photos AS (SELECT channel_id, count(DISTINCT track_id) AS photos FROM det WHERE {IN_ROI} GROUP BY ALL),"
    " ways AS (SELECT channel_id, count(*) FILTER (method = 'confirmed') AS confirmed, count(*) FILTER (method = 'inferred') AS inferred FROM transits GROUP BY ALL)"
    " SELECT f.channel_id, count(f.prev_seg) AS merges, coalesce(any_value(photos), 0) AS photos, coalesce(any_value(confirmed), 0) AS confirmed, coalesce(any_value(inferred), 0) AS inferred"
    " FROM fates f LEFT JOIN photos USING (channel_id) LEFT JOIN ways USING (channel_id) GROUP BY f.channel_id"
)
def transit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each channel, its confirmed and inferred transits, the tracks with a photo, and the merges of the stitcher."""
    rows = materialize(tracks.with_segments(tracks.with_roi(det(spark, sf_dir, piece=30), D.ROI)), "rows")
    fates = materialize(stitch.stitch(tracks.segments(rows)), "fates")
    found = direction.followed(rows, fates, D.arms(spark)).where("type = 'transit'")
    of = lambda how: F.count_if(F.col("method") == how).alias(how)
    transits = found.groupBy("channel_id").agg(of("confirmed"), of("inferred"))
    photos = tracks.best_photo(rows).groupBy("channel_id").agg(F.count(F.lit(1)).alias("photos"))
    merges = fates.groupBy("channel_id").agg(F.count("prev_seg").alias("merges"))
    return merges.join(photos, "channel_id", "left").join(transits, "channel_id", "left").na.fill(0)


@query(
    f"{BASE}, {RUNS}, late AS (SELECT *, min(frame) OVER (PARTITION BY channel_id, track_id, run) AS stopped_since FROM runs WHERE moving = 0),"
    " hit AS (SELECT channel_id, track_id, run, min(frame) AS frame FROM late WHERE frame - stopped_since >= 20 GROUP BY ALL),"
    " first AS (SELECT channel_id, track_id, min(frame) AS f0, min(pts_ms) AS p0, min_by(seg_id, frame) AS seg FROM seg GROUP BY ALL)"
    " SELECT l.channel_id, CAST(f.seg AS BIGINT) AS lineage_id, CAST(l.track_id AS VARCHAR) AS track_id, 'stagnant' AS type, l.class_name, NULL::VARCHAR AS entry_arm,"
    " NULL::VARCHAR AS exit_arm, NULL::VARCHAR AS method, TRUE AS was_stagnant, l.frame, f.f0 AS first_seen_frame, l.frame AS last_seen_frame, l.pts_ms - f.p0 AS duration_ms,"
    " CAST(trunc((l.frame - l.stopped_since) / 30.0::DOUBLE * 1000) AS BIGINT) AS stationary_ms, l.cx AS x, l.cy AS y,"
    " substr(sha256(l.channel_id || ':' || CAST(f.seg AS BIGINT) || ':' || l.frame || ':stagnant'), 1, 8) AS alert_id"
    " FROM hit h JOIN late l ON l.channel_id = h.channel_id AND l.track_id = h.track_id AND l.run = h.run AND l.frame = h.frame"
    " JOIN first f ON f.channel_id = h.channel_id AND f.track_id = h.track_id"
)
def stagnant_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return direction.alerts(det(spark, sf_dir), D.arms(spark), D.ROI, 20).where("type = 'stagnant'")


@query(
    f"WITH {D.DET_SQL}, first AS (SELECT channel_id, track_id, min(frame * 1000000000 + det_ord) AS f FROM det GROUP BY ALL)"
    " SELECT channel_id, track_id, CAST(dense_rank() OVER (PARTITION BY channel_id ORDER BY f) AS INT) AS seq_id FROM first"
)
def sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.sequential_ids(det(spark, sf_dir))


@query(
    f"{BASE} SELECT channel_id, track_id, count(*) FILTER (sqrt((cx - prev_cx) ** 2 + (cy - prev_cy) ** 2) > 15) AS n_jumps FROM steps GROUP BY ALL"
)
def id_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.jumps(roi(spark, sf_dir), 15)


@query(
    f"WITH {D.DET_SQL}, t AS (SELECT channel_id, track_id, max(frame) - min(frame) + 1 AS life FROM det GROUP BY ALL)"
    " SELECT channel_id, count(*) AS tracks, count(*) FILTER (life < 60) AS short, round(100.0 * count(*) FILTER (life < 60) / count(*), 2) AS short_pct,"
    " round(avg(life), 2) AS avg_life, list_sort(list(life))[count(*) // 2 + 1] AS upper_median, max(life) AS max_life FROM t GROUP BY ALL"
)
def track_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median is taken by ranks, so that no channel's lifetimes are gathered in one list."""
    life = tracks.lifetimes(det(spark, sf_dir)).select("channel_id", F.col("lifetime").alias("life"))
    own = Window.partitionBy("channel_id")
    ranked = life.groupBy("channel_id", "life").agg(F.count(F.lit(1)).alias("n"))
    ranked = ranked.withColumn("upto", F.sum("n").over(own.orderBy("life"))).withColumn("all", F.sum("n").over(own))
    short = F.sum(F.when(F.col("life") < 60, F.col("n")).otherwise(0))
    return ranked.groupBy("channel_id").agg(
        F.sum("n").alias("tracks"), short.alias("short"), F.round(100.0 * short / F.sum("n"), 2).alias("short_pct"),
        F.round(F.sum(F.col("life") * F.col("n")) / F.sum("n"), 2).alias("avg_life"),
        F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("life"))).alias("upper_median"), F.max("life").alias("max_life"),
    )


@query(
    f"WITH {D.DET_SQL}, f AS (SELECT channel_id, frame, count(*) AS c, avg(confidence) AS a FROM det GROUP BY ALL)"
    " SELECT channel_id, count(*) AS frames, CAST(sum(c) AS BIGINT) AS detections, round(sum(c) / count(*), 2) AS per_frame, max(c) AS most,"
    " round(avg(a), 4) AS avg_confidence FROM f GROUP BY ALL"
)
def detection_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = det(spark, sf_dir).groupBy("channel_id", "frame").agg(F.count(F.lit(1)).alias("c"), F.avg("confidence").alias("a"))
    return frames.groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("frames"), F.sum("c").alias("detections"), F.round(F.sum("c") / F.count(F.lit(1)), 2).alias("per_frame"),
        F.max("c").alias("most"), F.round(F.avg("a"), 4).alias("avg_confidence"),
    )


@query(
    f"WITH {D.DET_SQL}, f AS (SELECT channel_id, frame, count(*) AS n, count(DISTINCT track_id) AS tracks FROM det GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS frames,"
    " sum(n) OVER w AS total FROM f WINDOW w AS (PARTITION BY channel_id ORDER BY frame ROWS UNBOUNDED PRECEDING))"
    " SELECT channel_id, frame, frames, n, tracks, CAST(total AS BIGINT) AS total, round(total / frames, 1) AS mean FROM r WHERE frames % 25 = 0"
)
def progress_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At every 25th frame of a channel: its boxes and tracks, and the boxes seen so far, in all and a frame."""
    return tracks.progress(det(spark, sf_dir), 25)


@query(
    f"WITH {D.DET_SQL}, d AS (SELECT channel_id, track_id, pts_ms - lag(pts_ms) OVER (PARTITION BY channel_id, track_id ORDER BY frame) AS x FROM det)"
    " SELECT channel_id, median(x) AS median_delta FROM d WHERE x IS NOT NULL GROUP BY ALL"
)
def pts_delta_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("channel_id", "track_id").orderBy("frame")
    deltas = det(spark, sf_dir).select("channel_id", (F.col("pts_ms") - F.lag("pts_ms").over(own)).alias("x"))
    return deltas.where("x is not null").groupBy("channel_id").agg(F.median("x").alias("median_delta"))


@query(
    f"WITH {D.DET_SQL}, ends AS (SELECT channel_id, max(frame) AS last FROM det GROUP BY ALL)"
    " SELECT d.channel_id, d.track_id, last_value(d.cx) OVER w AS cx, last_value(d.cy) OVER w AS cy FROM det d JOIN ends e"
    " ON d.channel_id = e.channel_id AND d.frame = e.last WINDOW w AS (PARTITION BY d.channel_id, d.track_id ORDER BY d.frame)"
)
def latest_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the tracks are that the last frame of each channel holds."""
    rows = det(spark, sf_dir)
    ends = rows.groupBy(F.col("channel_id").alias("c")).agg(F.max("frame").alias("last"))
    at = rows.join(ends, (F.col("channel_id") == F.col("c")) & (F.col("frame") == F.col("last")))
    return at.groupBy("channel_id", "track_id").agg(F.max_by("cx", "det_ord").alias("cx"), F.max_by("cy", "det_ord").alias("cy"))


@query()
def tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes without their ids, tracked anew, over all frames from the first to the last of a channel."""
    from kerbside.operators import tracker as T

    rows = det(spark, sf_dir)
    right, low = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    own = rows.select(
        "channel_id", "frame", F.col("det_ord").alias("box"), F.col("x").alias("x1"), F.col("y").alias("y1"), right.alias("x2"), low.alias("y2"),
        F.col("confidence").alias("score"),
    )
    return T.track(own, frames=T.clock(own))
