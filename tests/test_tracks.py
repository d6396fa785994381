"""Geometry, the direction state machine, stitching and alerts, on hand-made cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kerbside.functions import geometry as G
from kerbside.operators import direction, stitch, tracks

ARMS = [("north", 400, 100, 600, 100), ("south", 400, 300, 600, 300), ("east", 600, 100, 600, 300), ("west", 400, 100, 400, 300)]
SQUARE, L_SHAPE = [(0, 0), (10, 0), (10, 10), (0, 10)], [(0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10)]


def test_points_in_polygons(spark):
    rows = spark.createDataFrame([(5.0, 5.0), (11.0, 5.0), (2.0, 8.0), (8.0, 8.0), (0.0, 0.0), (10.0, 10.0)], "x double, y double")
    x, y = F.col("x"), F.col("y")
    as_array = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in L_SHAPE])
    got = rows.select(
        G.point_in_polygon(x, y, SQUARE).alias("s"), G.point_in_polygon(x, y, L_SHAPE).alias("l"), G.point_in_polygon(x, y, []).alias("e"),
        G.point_in_polygon_array(x, y, as_array).alias("a"), G.point_in_polygon_array(x, y, F.lit(None).cast(as_type())).alias("n"),
    ).collect()
    assert [r.s for r in got] == [True, False, True, True, True, False]
    assert [r.l for r in got] == [False, False, True, False, True, False]
    assert [r.l for r in got] == [r.a for r in got] and not any(r.e for r in got) and all(r.n for r in got)


def as_type():
    return "array<struct<x:double,y:double>>"


def test_distances_rays_and_crossings(spark):
    one = spark.range(1)
    lit = lambda *v: [F.lit(float(x)) for x in v]
    got = one.select(
        G.segment_distance(*lit(5, 5, 0, 0, 10, 0)).alias("a"), G.segment_distance(*lit(13, 4, 0, 0, 10, 0)).alias("b"),
        G.segment_distance(*lit(3, 4, 0, 0, 0, 0)).alias("c"), G.ray_hit(*lit(0, 0, 1, 0, 5, -1, 5, 1)).alias("d"),
        G.ray_hit(*lit(0, 0, -1, 0, 5, -1, 5, 1)).alias("e"), G.ray_hit(*lit(0, 0, 0, 1, 5, -1, 5, 1)).alias("f"),
        G.angle_between(*lit(1, 0, 0, 1)).alias("g"), G.angle_between(*lit(0, 0, 0, 1)).alias("h"),
        G.crossing_direction(*lit(-1, 1)).alias("i"), G.crossing_direction(*lit(0, 1)).alias("j"),
    ).first()
    assert (got.a, got.b, got.c, got.d, got.e, got.f) == (5, 5, 5, 5, None, None)
    assert math.isclose(got.g, 90) and got.h == 0 and (got.i, got.j) == (1, None)


def path(*points):
    return [(float(x), float(y)) for x, y in points]


def test_nearest_arm():
    south = path(*[(500, 110 + 10 * i) for i in range(19)])
    assert direction.nearest_arm(south, ARMS, False) == "south" and direction.nearest_arm(south, ARMS, True) == "north"
    diagonal = path(*[(410 + 5 * i, 200 + 5 * i) for i in range(20)])
    assert direction.nearest_arm(diagonal, ARMS, True) == "west" and direction.nearest_arm(diagonal, ARMS, False) == "south"
    assert direction.nearest_arm(south[:3], ARMS, True) is None and direction.nearest_arm(path(*[(590, 200)] * 6), ARMS, True) == "east"
    jumped = south + path((50, 50), (51, 50), (52, 50))
    assert direction.without_jumps(jumped) == jumped and len(direction.without_jumps(path((0, 0), (200, 0)) + south)) >= 4


def machine(*events, limit=100):
    m, out = direction.Direction(), []
    for e, *a in events:
        if e == "enter":
            m.enter(*a)
        elif e == "leave":
            out.append(m.leave(a[0], lambda v=a: v[1] if len(v) > 1 else None))
        elif e == "lose":
            out.append(m.lose(lambda v=a: v[0], lambda v=a: v[1]))
        else:
            out.append(m.look(e == "slow", a[0], limit))
    return m, [x for x in out if x]


@pytest.mark.parametrize(
    ("events", "alerts", "state"),
    [
        ([("enter", "n"), ("leave", "s")], [("n", "s", "confirmed")], "completed"),
        ([("enter", "n"), ("leave", "n")], [], "unknown"),
        ([("enter", "n"), ("enter", "w"), ("leave", "s")], [("n", "s", "confirmed")], "completed"),
        ([("leave", "s", "w")], [("w", "s", "inferred")], "completed"),
        ([("leave", "s", "s")], [], "unknown"),
        ([("enter", "n"), ("lose", None, "s")], [("n", "s", "inferred")], "in_transit"),
        ([("lose", "n", "n")], [], "unknown"),
        ([("slow", 1), ("leave", "s")], [(None, "s", "confirmed")], "completed"),
        ([("slow", 1), ("slow", 100), ("slow", 101), ("slow", 102)], [True], "stagnant"),
        ([("slow", 1), ("moving", 50), ("slow", 60), ("slow", 160)], [True], "stagnant"),
        ([("enter", "n"), ("leave", "s"), ("slow", 5), ("moving", 9), ("lose", None, "w")], [("n", "s", "confirmed"), ("n", "w", "inferred")], "in_transit"),
        ([("slow", 1), ("slow", 101), ("enter", "n"), ("slow", 102)], [True, True], "stagnant"),
        ([("enter", "n"), ("slow", 3), ("moving", 4)], [], "in_transit"),
    ],
)
def test_transitions(events, alerts, state):
    m, out = machine(*events)
    assert out == alerts and m.state == state


def segment(seg, track, first, last, x=(0, 0), y=(0, 0), roi=True, end=1000, before=True, order=0):
    return {
        "channel_id": 1, "seg_id": seg, "track_id": track, "first_frame": first, "first_ord": order, "last_frame": last, "first_cx": x[0], "first_cy": y[0],
        "last_cx": x[1], "last_cy": y[1], "before_frame": last - 1 if before else None, "before_cx": x[1], "before_cy": y[1], "roi_at_end": roi, "channel_end": end,
    }


def fates(*rows):
    return {f["seg_id"]: f for f in stitch.match_session(list(rows))}


def test_stitching_limits_and_ties():
    near = fates(segment(1, 1, 0, 9, (0, 200), (0, 300)), segment(2, 2, 12, 50, (205, 0), (305, 0)))
    assert near[2]["prev_seg"] == 1 and near[2]["gap_frames"] == 2 and near[2]["lineage_id"] == 1
    assert fates(segment(1, 1, 0, 9), segment(2, 2, 12, 50, (101, 0)))[2]["prev_seg"] is None
    assert fates(segment(1, 1, 0, 9), segment(2, 2, 12, 50, (100, 0)))[2]["prev_seg"] == 1
    assert fates(segment(1, 1, 0, 9), segment(2, 2, 70, 80))[2]["prev_seg"] == 1
    late = fates(segment(1, 1, 0, 9), segment(2, 2, 71, 80))
    assert late[2]["prev_seg"] is None and late[1]["final_frame"] is None  # discarded with the new one's arrival
    assert fates(segment(1, 1, 0, 9), segment(2, 2, 72, 80))[1]["final_frame"] == 71
    assert fates(segment(1, 1, 0, 9, roi=False), segment(2, 2, 12, 50))[2]["prev_seg"] is None
    tie = fates(segment(1, 1, 0, 9, (0, 10)), segment(2, 2, 0, 9, (0, -10), order=1), segment(3, 3, 12, 50))
    assert tie[3]["prev_seg"] == 1
    assert fates(segment(1, 1, 0, 1000))[1]["final_frame"] is None and fates(segment(1, 1, 0, 990))[1]["final_frame"] == 1000


def test_sessions_do_not_change_the_matching(spark):
    rng = random.Random(4)
    rows = []
    for k in range(120):
        first = rng.randrange(0, 6000, 3)
        rows.append(segment(k, k, first, first + rng.randint(1, 40), (rng.randint(0, 200),) * 2, (rng.randint(0, 200),) * 2, order=k))
    end = max(r["last_frame"] for r in rows)
    for r in rows:
        r["channel_end"] = end
    whole = {f["seg_id"]: f["prev_seg"] for f in stitch.match_session(rows)}
    frame = spark.createDataFrame(rows, ", ".join(f"{k} {'boolean' if k == 'roi_at_end' else 'long'}" for k in rows[0])).drop("channel_end")
    got = stitch.stitch(frame).collect()
    assert {r.seg_id: r.prev_seg for r in got} == whole and sum(v is not None for v in whole.values()) > 10


def detections(spark, points, polygon=None):
    rows = [(1, f, f * 33, t, "car", 0, 0, 10, 10, 0.9, x, y, f) for t, f, x, y in points]
    from kerbside import schemas

    return tracks.with_segments(tracks.with_roi(spark.createDataFrame(rows, schemas.DETECTIONS), polygon))


def arms_table(spark):
    from kerbside import schemas

    return spark.createDataFrame([("s", "line", 0, "line", 0.0, 50.0, 100.0, 50.0, "left")], schemas.ARMS)


def test_crossings_beyond_ends_on_the_line_and_outside(spark):
    arms = arms_table(spark)
    count = lambda pts, polygon=None, **k: tracks.crossings(detections(spark, pts, polygon), arms, **k).count()
    assert count([(1, 0, 500, 40), (1, 1, 500, 60)]) == 1 and count([(1, 0, 500, 40), (1, 1, 500, 60)], strict=True) == 0
    assert count([(1, 0, 50, 40), (1, 1, 50, 50), (1, 2, 50, 60)]) == 0
    assert count([(1, 0, 50, 40), (1, 2, 50, 60)]) == 0  # a frame is missing
    box = [(0, 45), (100, 45), (100, 100), (0, 100)]
    assert count([(1, 0, 50, 40), (1, 1, 50, 60)], box) == 1 and count([(1, 0, 50, 60), (1, 1, 50, 40)], box) == 0


def test_alerts_end_to_end(spark):
    from kerbside import schemas

    points = [(7, f, 500, 65 + 10 * f) for f in range(30)]
    rows = [(1, f, f * 33, t, "car", 0, 0, 10, 10, 0.9, x, y, f) for t, f, x, y in points] + [(1, 200, 6600, 9, "car", 0, 0, 1, 1, 0.9, 900, 900, 1)]
    arms = spark.createDataFrame(
        [("s", a, k, a, *map(float, xy), {"north": "left", "south": "right", "east": "left", "west": "right"}[a]) for k, (a, *xy) in enumerate(ARMS)], schemas.ARMS
    )
    got = direction.alerts(spark.createDataFrame(rows, schemas.DETECTIONS), arms, None).collect()
    assert [(r.type, r.entry_arm, r.exit_arm, r.method) for r in got if r.track_id == "7"][:1] == [("transit", "north", "south", "confirmed")]


def test_the_report_stitches_once_and_channels_side_by_side(spark, monkeypatch):
    import glob

    from kerbside import storage
    from kerbside.plans import track_queries

    calls, own = [], stitch.stitch
    monkeypatch.setattr(stitch, "stitch", lambda *a, **k: calls.append(a) or own(*a, **k))
    folder = storage.shared_folder(spark).removeprefix("file://")
    seen = set(glob.glob(f"{folder}/matched-*"))
    track_queries.transit_report(spark, "/root/testdata/sf0.01")
    assert len(calls) == 1
    new = set(glob.glob(f"{folder}/matched-*")) - seen
    assert max(len(glob.glob(f"{n}/part-*")) for n in new) > 1
