"""Phases, evaluation, heat maps, sampling and crops, each with its SQL equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators import control, evaluation, heat, tracks
from kerbside.plans.curation_queries import BOXES, scenes
from kerbside.plans.scalar_queries import CROPS
from kerbside.plans.track_queries import det
from kerbside.sources import detections as D
from kerbside.storage import materialize
from kerbside.streaming import sources

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: What the commands of a site do, by the number of the row that they are made from.
ACTIONS = ["add", "analytics", "setup", "analytics", "review", "analytics", "remove"]
COMMANDS = f"""WITH {D.DET_SQL}, commands AS (
    SELECT channel_id, pts_ms, det_ord AS command_id, [{", ".join(f"'{a}'" for a in ACTIONS)}][det_ord // 29 % {len(ACTIONS)} + 1] AS action FROM det WHERE det_ord % 29 = 0),
known AS (
    SELECT *, coalesce(last_value(CASE WHEN action IN ('add', 'remove') THEN action = 'add' END IGNORE NULLS) OVER (
        PARTITION BY channel_id ORDER BY pts_ms, command_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS up FROM commands),
done AS (
    SELECT *, CASE action WHEN 'add' THEN 'setup' WHEN 'remove' THEN NULL ELSE action END AS phase FROM known WHERE up <> (action = 'add')),
spans AS (
    SELECT *, lag(phase) OVER w AS old_phase, count(*) FILTER (action IN ('add', 'analytics')) OVER w AS epoch,
        last_value(CASE WHEN action IN ('add', 'analytics') THEN pts_ms END IGNORE NULLS) OVER w AS epoch_start, lead(pts_ms) OVER w AS until FROM done
    WINDOW w AS (PARTITION BY channel_id ORDER BY pts_ms, command_id ROWS UNBOUNDED PRECEDING))"""


def site_commands(rows: DataFrame) -> DataFrame:
    """Commands of the operators of all channels, made from every 29th row."""
    names = F.array(*[F.lit(a) for a in ACTIONS])
    action = F.get(names, (F.floor(F.col("det_ord") / 29) % len(ACTIONS)).cast("int"))
    return rows.where("det_ord % 29 = 0").select("channel_id", "pts_ms", F.col("det_ord").alias("command_id"), action.alias("action"))


def states(rows: DataFrame) -> DataFrame:
    """The channels that are up after all commands, by name of their source."""
    last = control.effective(site_commands(rows)).groupBy("channel_id").agg(F.max_by("phase", F.struct("pts_ms", "command_id")).alias("phase"))
    return last.where("phase is not null").select(F.col("channel_id").alias("channel"), F.concat(F.lit("cam"), "channel_id").alias("source"), "phase")


STATES = f"""{COMMANDS}, last_ AS (SELECT channel_id, max_by(coalesce(phase, 'down'), pts_ms * 1000000000 + command_id) AS phase FROM spans GROUP BY ALL),
states AS (SELECT channel_id AS channel, 'cam' || channel_id AS source, phase FROM last_ WHERE phase <> 'down')"""


@query(
    f"{COMMANDS} SELECT d.channel_id, d.pts_ms, d.det_ord, s.phase, s.epoch, d.pts_ms - s.epoch_start AS epoch_ms FROM det d JOIN spans s"
    " ON d.channel_id = s.channel_id AND d.pts_ms >= s.pts_ms AND (s.until IS NULL OR d.pts_ms < s.until) WHERE s.phase IN ('setup', 'analytics')"
)
def phased_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that are processed, in the phase and the epoch in which they are."""
    rows = det(spark, sf_dir)
    return control.phased(rows.select("channel_id", "pts_ms", "det_ord"), site_commands(rows))


@query(f"{COMMANDS} SELECT channel_id, pts_ms, command_id, old_phase, phase FROM spans WHERE action NOT IN ('add', 'remove') AND old_phase <> phase")
def phase_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.changes(site_commands(det(spark, sf_dir)))


@query(
    f"{COMMANDS}, review AS (SELECT channel_id, pts_ms, command_id FROM spans WHERE phase = 'review' AND old_phase <> 'review'),"
    " seen AS (SELECT d.channel_id, d.pts_ms, d.frame FROM det d JOIN spans s ON d.channel_id = s.channel_id AND d.pts_ms >= s.pts_ms AND (s.until IS NULL OR d.pts_ms < s.until)"
    " WHERE s.phase IN ('setup', 'analytics')) SELECT r.channel_id, r.command_id, max(s.frame) AS frame FROM review r LEFT JOIN seen s ON s.channel_id = r.channel_id"
    " AND s.pts_ms < r.pts_ms GROUP BY ALL"
)
def frames_kept_for_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last frame that was processed before each change to review, which is kept as the picture of the channel."""
    rows = det(spark, sf_dir)
    return control.last_before_review(rows.select("channel_id", "pts_ms", "frame"), site_commands(rows))


def judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two runs of a detector, which shift boxes by up to 8 and up to 30 pixels and see boxes that are not there, and the true boxes."""
    own = materialize(scenes(spark, sf_dir, "class_name"), "judged")
    shifted = lambda by: {c: F.col(c) + F.col("box") % by for c in ("x1", "x2")}
    runs = own.where("box % 5 <> 0").withColumns(shifted(9)).withColumn("run", F.lit("first"))
    runs = runs.unionByName(own.where("box % 8 <> 0").withColumns(shifted(31)).withColumn("run", F.lit("second")))
    return runs, own.where("box % 7 <> 0").drop("score")


RUNS = f"""{BOXES}, named AS (SELECT b.*, d.class_name FROM boxes b JOIN det d ON d.det_ord = b.box),
pred AS (
    SELECT 'first' AS run, * REPLACE (x1 + box % 9 AS x1, x2 + box % 9 AS x2) FROM named WHERE box % 5 <> 0
    UNION ALL SELECT 'second', * REPLACE (x1 + box % 31 AS x1, x2 + box % 31 AS x2) FROM named WHERE box % 8 <> 0),
truth AS (SELECT * FROM named WHERE box % 7 <> 0),
met AS (
    SELECT a.run, a.class_name, a.channel_id, a.pic, a.box AS box, b.box AS true_box, a.score,
        (greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))::DOUBLE AS common,
        ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1))::DOUBLE AS areas
    FROM pred a JOIN truth b ON a.channel_id = b.channel_id AND a.pic = b.pic AND a.class_name = b.class_name),
asked AS (
    SELECT *, common / greatest(areas - common, 1e-9) AS iou FROM met
    QUALIFY row_number() OVER (PARTITION BY run, class_name, channel_id, pic, box ORDER BY iou DESC, true_box) = 1),
won AS (
    SELECT run, class_name, channel_id, pic, box, k FROM asked, (SELECT unnest(range(10)) AS k, unnest([{", ".join(map(repr, evaluation.THRESHOLDS))}]::DOUBLE[]) AS t) WHERE iou >= t
    QUALIFY row_number() OVER (PARTITION BY run, class_name, channel_id, pic, true_box, k ORDER BY score DESC, box) = 1),
sizes AS (
    SELECT run, class_name, n_truth, coalesce(n_pred, 0) AS n_pred
    FROM (SELECT run, class_name, n_truth FROM (SELECT class_name, count(*) AS n_truth FROM truth GROUP BY ALL), (SELECT DISTINCT run FROM pred)) LEFT JOIN (SELECT run, class_name, count(*) AS n_pred FROM pred GROUP BY ALL) USING (run, class_name))"""

AREAS = f"""{RUNS}, ranked AS (
    SELECT p.run, p.class_name, g.k, row_number() OVER w AS i, sum(CASE WHEN won.box IS NULL THEN 0 ELSE 1 END) OVER w AS tp
    FROM pred p CROSS JOIN (SELECT unnest(range(10)) AS k) g LEFT JOIN won ON won.run = p.run AND won.class_name = p.class_name AND won.channel_id = p.channel_id AND won.pic = p.pic AND won.box = p.box AND won.k = g.k
    WINDOW w AS (PARTITION BY p.run, p.class_name, g.k ORDER BY p.score DESC, p.channel_id, p.pic, p.box ROWS UNBOUNDED PRECEDING)),
points AS (
    SELECT run, class_name, k, i, CAST(tp AS BIGINT) AS tp, tp / i AS p, n_truth FROM ranked JOIN sizes USING (run, class_name)
    UNION ALL SELECT run, class_name, k, 0, 0, 1.0, n_truth FROM sizes, (SELECT unnest(range(10)) AS k) WHERE n_pred > 0
    UNION ALL SELECT run, class_name, k, n_pred + 1, n_truth, 0.0, n_truth FROM sizes, (SELECT unnest(range(10)) AS k) WHERE n_pred > 0),
curves AS (
    SELECT *, max(p) OVER (PARTITION BY run, class_name, k ORDER BY i DESC) AS env FROM points),
lines AS (
    SELECT *, lead(tp) OVER w AS next_tp, lead(env) OVER w AS next_env FROM curves WINDOW w AS (PARTITION BY run, class_name, k ORDER BY i)),
heights AS (
    SELECT run, class_name, k, level, CASE WHEN next_tp IS NULL THEN env ELSE env + (next_env - env) * (level / 100.0::DOUBLE - tp / n_truth) / ((next_tp - tp) / n_truth) END AS y
    FROM lines, (SELECT unnest(range(101)) AS level) WHERE 100 * tp <= level * n_truth AND (next_tp IS NULL OR 100 * next_tp > level * n_truth)),
areas AS (SELECT run, class_name, k, sum(y * CASE WHEN level IN (0, 100) THEN 0.005::DOUBLE ELSE 0.01::DOUBLE END) AS ap FROM heights GROUP BY ALL),
classes AS (
    SELECT s.run, s.class_name, s.n_truth, s.n_pred, coalesce(sum(ap) FILTER (k = 0), 0) AS ap50, coalesce(sum(ap) / 10, 0) AS ap50_95 FROM sizes s LEFT JOIN areas USING (run, class_name) GROUP BY ALL)"""


@query(f"{AREAS} SELECT run, class_name, n_truth, n_pred, round(ap50, 6) AS ap50, round(ap50_95, 6) AS ap50_95 FROM classes")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, truth = judged(spark, sf_dir)
    found = evaluation.average_precision(evaluation.hits(runs, truth, ["channel_id", "pic"], "run"), truth, ["channel_id", "pic"], "run")
    return found.select("run", "class_name", "n_truth", "n_pred", F.round("ap50", 6).alias("ap50"), F.round("ap50_95", 6).alias("ap50_95"))


@query(
    f"{AREAS}, grid AS (SELECT unnest(range(1000)) AS step), held AS (SELECT p.run, p.class_name, CAST(floor(p.score * 999) AS INT) AS step, count(*) AS n, count(won.box) AS tp"
    " FROM pred p LEFT JOIN won ON won.run = p.run AND won.class_name = p.class_name AND won.channel_id = p.channel_id AND won.pic = p.pic AND won.box = p.box AND won.k = 0 GROUP BY ALL),"
    " steps AS (SELECT run, class_name, g.step, n_truth, coalesce(sum(h.n), 0) AS n, coalesce(sum(h.tp), 0) AS tp FROM sizes CROSS JOIN grid g LEFT JOIN held h USING (run, class_name)"
    " WHERE h.step IS NULL OR h.step >= g.step GROUP BY ALL UNION ALL SELECT run, class_name, g.step, n_truth, 0, 0 FROM sizes s, grid g WHERE g.step > (SELECT max(step) FROM held h"
    " WHERE h.run = s.run AND h.class_name = s.class_name)),"
    " rates AS (SELECT *, CASE WHEN n = 0 THEN 1 ELSE tp / n END AS p, tp / n_truth AS r FROM steps),"
    " mean AS (SELECT run, step, avg(p) AS p, avg(r) AS r, avg(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END) AS f FROM rates GROUP BY ALL),"
    " smooth AS (SELECT a.run, a.step, round(avg(b.f), 9) AS f FROM mean a, unnest(range(-50, 51)) AS o(d) JOIN mean b ON b.run = a.run AND b.step = least(999, greatest(0, a.step + d)) GROUP BY ALL),"
    " best AS (SELECT run, min_by(step, (-f, step)) AS step FROM smooth GROUP BY ALL),"
    " maps AS (SELECT run, avg(ap50) AS map50, avg(ap50_95) AS map50_95 FROM classes GROUP BY ALL),"
    " each AS (SELECT run, round(map50, 4) AS map50, round(map50_95, 4) AS map50_95, round(p, 4) AS precision, round(r, 4) AS recall, round(0.1::DOUBLE * map50 + 0.9::DOUBLE * map50_95, 4) AS fitness"
    " FROM maps JOIN best USING (run) JOIN mean USING (run, step))"
    " SELECT e.*, round(e.map50 - f.map50, 4) AS delta_map50, round(e.map50_95 - f.map50_95, 4) AS delta_map50_95, round(e.precision - f.precision, 4) AS delta_precision,"
    " round(e.recall - f.recall, 4) AS delta_recall, round(e.fitness - f.fitness, 4) AS delta_fitness FROM each e, each f WHERE f.run = 'first'"
)
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs against the true boxes, and how the later one differs from the first."""
    runs, truth = judged(spark, sf_dir)
    return evaluation.report(evaluation.hits(runs, truth, ["channel_id", "pic"], "run"), truth, ["channel_id", "pic"], "run", "first")


@query(
    f"WITH {D.DET_SQL}, b AS (SELECT *, x + w > 0 AND x < 1920 AND y + h > 0 AND y < 1080 AS inside FROM det),"
    " s AS (SELECT channel_id, inside, x, y, w, h, lag(inside) OVER o AS p_in, lag(x) OVER o AS px, lag(y) OVER o AS py, lag(w) OVER o AS pw, lag(h) OVER o AS ph FROM b"
    " WINDOW o AS (PARTITION BY channel_id, track_id ORDER BY frame, det_ord)),"
    " c AS (SELECT row_number() OVER () AS id, channel_id, CASE WHEN inside THEN [greatest(0, x) // 10, greatest(0, y) // 10, least(1919, x + w - 1) // 10, least(1079, y + h - 1) // 10] END AS a,"
    " CASE WHEN p_in THEN [greatest(0, px) // 10, greatest(0, py) // 10, least(1919, px + pw - 1) // 10, least(1079, py + ph - 1) // 10] END AS b FROM s WHERE p_in IS NOT NULL),"
    " sides AS (SELECT id, channel_id, unnest([a, b]) AS q FROM c),"
    " painted AS (SELECT id, channel_id, u, unnest(range(q[2], q[4] + 1)) AS v FROM (SELECT id, channel_id, q, unnest(range(q[1], q[3] + 1)) AS u FROM sides WHERE q IS NOT NULL)),"
    " once AS (SELECT id, channel_id, u, v FROM painted GROUP BY ALL HAVING count(*) = 1), heat AS (SELECT channel_id, u, v, count(*) AS heat FROM once GROUP BY ALL),"
    " top AS (SELECT channel_id, quantile_cont(heat, 0.99) AS top FROM heat GROUP BY ALL)"
    " SELECT channel_id, u, v, heat, CAST(floor(least(heat, top) / top * 255) AS INT) AS level FROM heat JOIN top USING (channel_id)"
)
def motion_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heat.levels(heat.motion(det(spark, sf_dir)))


@query(
    f"{CROPS}, asked AS (SELECT *, w * h * confidence AS score, max(w * h * confidence) OVER (PARTITION BY channel_id, track_id ORDER BY frame, det_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best"
    f" FROM cut WHERE cx BETWEEN 251 AND 1649 AND cy BETWEEN 151 AND 949),"
    " served AS (SELECT *, 'f' || channel_id || '-' || frame AS picture FROM asked WHERE (best IS NULL OR score > best) AND frame % 4 <> 0 AND EXISTS (SELECT 1 FROM det d WHERE d.channel_id = asked.channel_id AND d.frame = asked.frame))"
    " SELECT channel_id, track_id, frame, round(score, 6) AS score, picture, side, src_x1, src_y1, src_x2, src_y2, dst_x, dst_y FROM served"
    " QUALIFY row_number() OVER (PARTITION BY channel_id, track_id ORDER BY score DESC, frame) = 1"
)
def best_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best photo of each track of those whose picture came: every fourth frame of a camera has none."""
    rows = tracks.with_roi(det(spark, sf_dir), D.ROI)
    inner = rows.where("cx between 251 and 1649 and cy between 151 and 949")
    name = F.concat_ws("-", F.concat(F.lit("f"), "channel_id"), "frame")
    pictures = rows.where("frame % 4 <> 0").groupBy("channel_id", "frame", "pts_ms").agg(F.first(name).alias("picture")).withColumns({"width": F.lit(1920), "height": F.lit(1080)})
    return sources.best_crops(sources.crops(sources.requests(inner), pictures)).withColumn("score", F.round("score", 6))


@query(
    f"WITH {D.DET_SQL}, first AS (SELECT 'site' || channel_id AS site, track_id AS video, pts_ms // 1000 AS slot, min_by(frame, frame) AS frame FROM det GROUP BY ALL)"
    " SELECT site, video, slot, frame, row_number() OVER (PARTITION BY site ORDER BY video, slot) AS number FROM first"
)
def sampled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame a second of every video, numbered by site; each track's rows stand for a video."""
    rows = det(spark, sf_dir).select(F.concat(F.lit("site"), "channel_id").alias("site"), F.col("track_id").alias("video"), "frame", "pts_ms")
    return sources.numbered(sources.samples(rows))


@query(
    f"WITH {D.DET_SQL}, f AS (SELECT DISTINCT channel_id AS source_id, frame, pts_ms FROM det)"
    " SELECT epoch_ms(pts_ms // 33 * 33) AS start, CAST(floor(source_id / 8) AS BIGINT) AS part, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS sources, CAST(count(*) AS INT) AS n,"
    " string_agg(source_id || ':' || frame, ',' ORDER BY source_id, frame) AS frames FROM f GROUP BY ALL"
)
def source_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of all cameras in batches of those that came within the same 33 milliseconds."""
    frames = det(spark, sf_dir).select(F.col("channel_id").alias("source_id"), "frame", "pts_ms").distinct()
    found = sources.batched(frames.withColumn("arrived", F.timestamp_millis("pts_ms")))
    listed = F.array_join(F.transform("frames", lambda x: F.concat_ws(":", x["source_id"], x["frame"])), ",")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "part", F.array_join("sources", ",").alias("sources"), "n", listed.alias("frames"))
