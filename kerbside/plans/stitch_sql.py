"""Stitching and the direction machine in SQL, as recursions over the segments of a channel and the events of a vehicle.

Written from what the operators return, for DuckDB: lost tracks are found by conditions on time, not by a list that is kept
up to date, and each event of a vehicle is one step of a recursion over all vehicles."""

from __future__ import annotations

from kerbside.operators.direction import FPS, HISTORY, JUMP_PX, LEAST_HEADING, STAGNANT_SECONDS, TURN_DEGREES
from kerbside.operators.stitch import MAX_AGE, MAX_PREDICTED, MAX_PX
from kerbside.sources.detections import ARMS_SQL, FRAGMENTED_SQL

IN_ROI = "(cx >= 250 AND cx < 1650 AND cy >= 150 AND cy < 950)"

#: ``fates`` and ``roots`` of all segments of the fragmented detections.
STITCHED = f"""WITH RECURSIVE {FRAGMENTED_SQL}, fresh AS (
    SELECT *, {IN_ROI} AS in_roi, CASE WHEN frame - lag(frame) OVER (PARTITION BY channel_id, track_id ORDER BY frame, det_ord) = 1 THEN 0 ELSE 1 END AS is_new FROM det),
seg AS (
    SELECT *, CAST(track_id * 1000 + sum(is_new) OVER (PARTITION BY channel_id, track_id ORDER BY frame, det_ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg_id FROM fresh),
steps AS (
    SELECT *, lag(frame) OVER w AS p_frame, lag(cx) OVER w AS prev_cx, lag(cy) OVER w AS prev_cy FROM seg WINDOW w AS (PARTITION BY channel_id, seg_id ORDER BY frame, det_ord)),
stops AS (
    SELECT channel_id, track_id, seg_id, min(frame) AS first_frame, min_by(det_ord, frame) AS first_ord, min_by(cx, frame) AS first_cx, min_by(cy, frame) AS first_cy,
        max(frame) AS last_frame, max_by(cx, frame) AS last_cx, max_by(cy, frame) AS last_cy, max_by(in_roi, frame) AS roi_at_end, count(*) AS n_rows,
        arg_max_null(p_frame, frame) AS before_frame, arg_max_null(prev_cx, frame) AS before_cx, arg_max_null(prev_cy, frame) AS before_cy FROM steps GROUP BY ALL),
segs AS (
    SELECT *, max(last_frame) OVER (PARTITION BY channel_id) AS channel_end, row_number() OVER (PARTITION BY channel_id ORDER BY first_frame, first_ord) AS k FROM stops),
losses AS (
    SELECT *, last_frame + 1 AS lost_frame, last_frame + 1 + {MAX_AGE} + 1 AS due FROM segs WHERE roi_at_end AND last_frame < channel_end),
lost AS (
    SELECT l.*, (SELECT min(o.lost_frame) FROM losses o WHERE o.channel_id = l.channel_id AND o.track_id = l.track_id AND o.lost_frame > l.lost_frame) AS again FROM losses l),
walk AS (
    SELECT DISTINCT channel_id, CAST(0 AS BIGINT) AS k, NULL::BIGINT AS seg_id, NULL::BIGINT AS prev_seg, NULL::DOUBLE AS distance, NULL::BIGINT AS gap_frames, []::BIGINT[] AS taken,
        []::STRUCT(seg BIGINT, f BIGINT, x BIGINT, y BIGINT)[] AS carried FROM segs
    UNION ALL
    SELECT channel_id, k, seg_id, CASE WHEN far <= {MAX_PX} THEN e_seg END, CASE WHEN far <= {MAX_PX} THEN far END, CASE WHEN far <= {MAX_PX} THEN gap END,
        CASE WHEN far <= {MAX_PX} THEN list_append(taken, e_seg) ELSE taken END,
        CASE WHEN far <= {MAX_PX} AND n_rows = 1 THEN list_append(carried, {{'seg': seg_id, 'f': e_frame, 'x': e_x, 'y': e_y}}) ELSE carried END
    FROM (
        SELECT *, sqrt((first_cx - (e_x + CASE WHEN e_frame > b_frame THEN (e_x - b_x)::DOUBLE / (e_frame - b_frame) * least(gap, {MAX_PREDICTED}) ELSE 0 END)) ** 2
            + (first_cy - (e_y + CASE WHEN e_frame > b_frame THEN (e_y - b_y)::DOUBLE / (e_frame - b_frame) * least(gap, {MAX_PREDICTED}) ELSE 0 END)) ** 2) AS far
        FROM (
            SELECT w.channel_id, r.k, r.seg_id, r.n_rows, r.first_cx, r.first_cy, w.taken, w.carried, e.seg_id AS e_seg, e.last_frame AS e_frame, e.last_cx AS e_x, e.last_cy AS e_y,
                e.first_frame AS e_first, e.first_ord AS e_ord, r.first_frame - e.lost_frame AS gap,
                coalesce(e.before_frame, list_filter(w.carried, lambda c: c.seg = e.seg_id)[1].f, e.last_frame) AS b_frame,
                coalesce(e.before_cx, list_filter(w.carried, lambda c: c.seg = e.seg_id)[1].x) AS b_x, coalesce(e.before_cy, list_filter(w.carried, lambda c: c.seg = e.seg_id)[1].y) AS b_y
            FROM walk w JOIN segs r ON r.channel_id = w.channel_id AND r.k = w.k + 1
            LEFT JOIN lost e ON e.channel_id = r.channel_id AND e.lost_frame < r.first_frame AND e.due > r.first_frame AND (e.again IS NULL OR e.again >= r.first_frame)
                AND NOT list_contains(w.taken, e.seg_id))
        QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY far NULLS LAST, e_frame, e_first, e_ord) = 1)),
fates AS (
    SELECT s.channel_id, s.seg_id, w.prev_seg, w.distance, w.gap_frames, l.lost_frame,
        CASE WHEN l.seg_id IS NULL OR t.seg_id IS NOT NULL OR l.again < l.due THEN NULL WHEN l.due > s.channel_end THEN s.channel_end
            WHEN EXISTS (SELECT 1 FROM segs o WHERE o.channel_id = s.channel_id AND o.first_frame = l.due) THEN NULL ELSE l.due END AS final_frame
    FROM segs s JOIN walk w ON w.channel_id = s.channel_id AND w.seg_id = s.seg_id LEFT JOIN lost l ON l.channel_id = s.channel_id AND l.seg_id = s.seg_id
    LEFT JOIN walk t ON t.channel_id = s.channel_id AND t.prev_seg = s.seg_id),
roots AS (
    SELECT channel_id, seg_id, seg_id AS lineage_id FROM fates WHERE prev_seg IS NULL
    UNION ALL SELECT f.channel_id, f.seg_id, r.lineage_id FROM roots r JOIN fates f ON f.channel_id = r.channel_id AND f.prev_seg = r.seg_id)"""

#: ``transits``: alerts of all vehicles, by a machine of one event a step.
TRANSITS = f"""{STITCHED}, {ARMS_SQL}, whole AS (
    SELECT s.*, r.lineage_id, f.final_frame, row_number() OVER w AS p, count(*) OVER (PARTITION BY s.channel_id, r.lineage_id) AS n,
        sqrt((cx - lag(cx, 29) OVER w) ** 2 + (cy - lag(cy, 29) OVER w) ** 2) AS displacement, s.in_roi AND s.prev_cx IS NOT NULL AS looked
    FROM steps s JOIN roots r ON r.channel_id = s.channel_id AND r.seg_id = s.seg_id JOIN fates f ON f.channel_id = s.channel_id AND f.seg_id = s.seg_id
    WINDOW w AS (PARTITION BY s.channel_id, r.lineage_id ORDER BY s.frame, s.det_ord)),
sides AS (
    SELECT w.channel_id, lineage_id, p, arm_id, arm_ord, junction_side, (x2 - x1) * (prev_cy - y1) - (y2 - y1) * (prev_cx - x1) AS was,
        (x2 - x1) * (cy - y1) - (y2 - y1) * (cx - x1) AS now FROM whole w, arms WHERE looked),
happened AS (
    SELECT channel_id, lineage_id, p, arm_ord AS o, CASE WHEN (was < 0) = (junction_side = 'left') THEN 'entry' ELSE 'exit' END AS kind, arm_id AS arm, FALSE AS slow FROM sides WHERE was::HUGEINT * now < 0
    UNION ALL SELECT channel_id, lineage_id, p, 100, 'look', NULL, displacement < 15 FROM whole WHERE looked AND displacement IS NOT NULL
    UNION ALL SELECT channel_id, lineage_id, p, 101, 'end', NULL, FALSE FROM whole WHERE p = n AND final_frame IS NOT NULL),
asked AS (SELECT DISTINCT channel_id, lineage_id, p FROM happened WHERE kind IN ('exit', 'end')),
paths AS (
    SELECT a.channel_id, a.lineage_id, a.p, list(w.cx::DOUBLE ORDER BY w.p) AS xs, list(w.cy::DOUBLE ORDER BY w.p) AS ys
    FROM asked a JOIN whole w ON w.channel_id = a.channel_id AND w.lineage_id = a.lineage_id AND w.p BETWEEN a.p - {HISTORY - 1} AND a.p GROUP BY ALL HAVING count(*) >= 4),
jumps AS (
    SELECT *, list_filter(range(1, len(xs)), lambda i: sqrt((xs[i + 1] - xs[i]) ** 2 + (ys[i + 1] - ys[i]) ** 2) > {JUMP_PX}) AS gaps FROM paths),
clean AS (
    SELECT channel_id, lineage_id, p, CASE WHEN len(gaps) > 0 AND gaps[-1] - gaps[1] >= 4 THEN xs[gaps[1] + 1:gaps[-1]] ELSE xs END AS xs,
        CASE WHEN len(gaps) > 0 AND gaps[-1] - gaps[1] >= 4 THEN ys[gaps[1] + 1:gaps[-1]] ELSE ys END AS ys FROM jumps),
parts AS (SELECT *, len(xs) AS n, least(5, len(xs) // 2) AS m, len(xs) // 4 AS low, 3 * len(xs) // 4 AS high FROM clean),
leaving AS (
    SELECT *, xs[n] - xs[n - m + 1] AS hx, ys[n] - ys[n - m + 1] AS hy, xs[high + 1] - xs[low + 1] AS sx, ys[high + 1] - ys[low + 1] AS sy FROM parts),
turned AS (
    SELECT *, least(sqrt(hx * hx + hy * hy), sqrt(sx * sx + sy * sy)) >= 1e-9 AND degrees(acos(greatest(-1.0, least(1.0,
        (hx * sx + hy * sy) / nullif(sqrt(hx * hx + hy * hy) * sqrt(sx * sx + sy * sy), 0))))) > {TURN_DEGREES} AS turn FROM leaving),
tips AS (
    SELECT channel_id, lineage_id, p, 'entry' AS side, list_avg(xs[1:m]) AS ox, list_avg(ys[1:m]) AS oy, xs[1] - xs[m] AS hx, ys[1] - ys[m] AS hy FROM parts
    UNION ALL SELECT channel_id, lineage_id, p, 'exit', CASE WHEN turn AND m >= 2 THEN list_avg(xs[high - m + 1:high]) ELSE list_avg(xs[n - m + 1:n]) END,
        CASE WHEN turn AND m >= 2 THEN list_avg(ys[high - m + 1:high]) ELSE list_avg(ys[n - m + 1:n]) END, CASE WHEN turn THEN sx ELSE hx END, CASE WHEN turn THEN sy ELSE hy END FROM turned),
lines AS (SELECT *, (x2 - x1)::DOUBLE AS dx, (y2 - y1)::DOUBLE AS dy FROM tips, arms),
rays AS (
    SELECT *, hx * dy - hy * dx AS across, greatest(0.0, least(1.0, ((ox - x1) * dx + (oy - y1) * dy) / (dx * dx + dy * dy))) AS along FROM lines),
measured AS (
    SELECT *, CASE WHEN abs(across) >= 1e-12 AND sqrt(hx * hx + hy * hy) > {LEAST_HEADING} AND ((x1 - ox) * hy - (y1 - oy) * hx) / across BETWEEN 0 AND 1
        AND ((x1 - ox) * dy - (y1 - oy) * dx) / across >= 0 THEN ((x1 - ox) * dy - (y1 - oy) * dx) / across END AS t,
        sqrt((ox - x1 - along * dx) ** 2 + (oy - y1 - along * dy) ** 2) AS apart FROM rays),
inferred AS (
    SELECT channel_id, lineage_id, p, max(arm_id) FILTER (side = 'entry') AS came, max(arm_id) FILTER (side = 'exit') AS went FROM (
        SELECT *, row_number() OVER (PARTITION BY channel_id, lineage_id, p, side ORDER BY t NULLS LAST, CASE WHEN t IS NULL THEN apart ELSE 0 END, arm_ord) AS r FROM measured)
    WHERE r = 1 GROUP BY ALL),
ordered AS (
    SELECT h.*, i.came, i.went, w.frame, row_number() OVER (PARTITION BY h.channel_id, h.lineage_id ORDER BY h.p, h.o) AS k
    FROM happened h JOIN whole w ON w.channel_id = h.channel_id AND w.lineage_id = h.lineage_id AND w.p = h.p
    LEFT JOIN inferred i ON i.channel_id = h.channel_id AND i.lineage_id = h.lineage_id AND i.p = h.p),
machine AS (
    SELECT DISTINCT channel_id, lineage_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS p, '' AS kind, 'unknown' AS state, NULL::VARCHAR AS entry, NULL::BIGINT AS since, 'unknown' AS before_stop,
        FALSE AS was_stagnant, NULL::VARCHAR AS out_entry, NULL::VARCHAR AS out_exit, NULL::VARCHAR AS method FROM ordered
    UNION ALL
    SELECT m.channel_id, m.lineage_id, e.k, e.p, e.kind,
        CASE WHEN e.kind = 'entry' THEN CASE WHEN m.state IN ('unknown', 'waiting', 'stagnant') THEN 'in_transit' ELSE m.state END
            WHEN e.kind = 'exit' THEN CASE WHEN m.state = 'completed' THEN m.state WHEN m.state = 'unknown' THEN CASE WHEN e.came IS NULL OR e.came = e.arm THEN m.state ELSE 'completed' END
                WHEN e.arm = m.entry THEN 'unknown' ELSE 'completed' END
            WHEN e.kind = 'look' AND e.slow THEN CASE WHEN m.state <> 'stagnant' AND e.frame - coalesce(m.since, e.frame) >= {int(STAGNANT_SECONDS * FPS)} THEN 'stagnant'
                WHEN m.state IN ('waiting', 'stagnant') THEN m.state ELSE 'waiting' END
            WHEN e.kind = 'look' AND m.state IN ('waiting', 'stagnant') THEN CASE WHEN m.entry IS NOT NULL THEN 'in_transit' ELSE m.before_stop END
            ELSE m.state END,
        CASE WHEN e.kind = 'entry' AND m.state IN ('unknown', 'waiting', 'stagnant') THEN e.arm
            WHEN e.kind = 'exit' AND m.state = 'unknown' AND e.came IS NOT NULL AND e.came <> e.arm THEN e.came
            WHEN e.kind = 'exit' AND m.state NOT IN ('completed', 'unknown') AND e.arm = m.entry THEN NULL ELSE m.entry END,
        CASE WHEN e.kind = 'look' AND e.slow THEN coalesce(m.since, e.frame) WHEN e.kind = 'look' AND m.state IN ('waiting', 'stagnant') THEN NULL ELSE m.since END,
        CASE WHEN e.kind = 'look' AND e.slow AND m.state NOT IN ('waiting', 'stagnant') THEN m.state ELSE m.before_stop END,
        m.was_stagnant OR (e.kind = 'look' AND e.slow AND m.state <> 'stagnant' AND e.frame - coalesce(m.since, e.frame) >= {int(STAGNANT_SECONDS * FPS)}),
        CASE WHEN e.kind = 'exit' AND m.state = 'unknown' AND e.came <> e.arm THEN e.came WHEN e.kind = 'exit' AND m.state NOT IN ('completed', 'unknown') AND e.arm IS DISTINCT FROM m.entry THEN m.entry
            WHEN e.kind = 'end' AND m.state <> 'completed' THEN CASE WHEN m.state = 'unknown' THEN e.came ELSE m.entry END END,
        CASE WHEN e.kind = 'exit' AND m.state = 'unknown' AND e.came <> e.arm THEN e.arm WHEN e.kind = 'exit' AND m.state NOT IN ('completed', 'unknown') AND e.arm IS DISTINCT FROM m.entry THEN e.arm
            WHEN e.kind = 'end' AND m.state = 'unknown' AND e.came IS NOT NULL AND e.went <> e.came THEN e.went
            WHEN e.kind = 'end' AND m.state NOT IN ('completed', 'unknown') AND e.went IS DISTINCT FROM m.entry THEN e.went END,
        CASE WHEN e.kind = 'exit' AND m.state NOT IN ('completed', 'unknown') THEN 'confirmed' ELSE 'inferred' END
    FROM machine m JOIN ordered e ON e.channel_id = m.channel_id AND e.lineage_id = m.lineage_id AND e.k = m.k + 1),
firsts AS (SELECT channel_id, lineage_id, frame AS first_frame, pts_ms AS first_pts FROM whole WHERE p = 1),
transits AS (
    SELECT m.channel_id, m.lineage_id, CAST(w.track_id AS VARCHAR) AS track_id, 'transit' AS type, w.class_name, m.out_entry AS entry_arm, m.out_exit AS exit_arm, m.method, m.was_stagnant,
        CASE WHEN m.kind = 'end' THEN w.final_frame ELSE w.frame END AS frame, f.first_frame AS first_seen_frame, CASE WHEN m.kind = 'end' THEN w.final_frame ELSE w.frame END AS last_seen_frame,
        w.pts_ms - f.first_pts AS duration_ms, NULL::BIGINT AS stationary_ms, w.cx AS x, w.cy AS y,
        substr(sha256(m.channel_id || ':' || m.lineage_id || ':' || CASE WHEN m.kind = 'end' THEN w.final_frame ELSE w.frame END || ':transit:' || m.out_exit), 1, 8) AS alert_id
    FROM machine m JOIN whole w ON w.channel_id = m.channel_id AND w.lineage_id = m.lineage_id AND w.p = m.p JOIN firsts f ON f.channel_id = m.channel_id AND f.lineage_id = m.lineage_id
    WHERE m.out_exit IS NOT NULL)"""
