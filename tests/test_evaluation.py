"""Average precision against interpolation in numpy, the heat map against painting, near pairs against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from kerbside.operators import boxes, evaluation, heat, ranges
from pyspark.sql import functions as F

BOXES = "channel_id long, pic long, class_name string, box long, x1 double, y1 double, x2 double, y2 double"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    return both / max((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both, 1e-9)


def scene(seed, n=120):
    rng = random.Random(seed)
    truth = []
    for k in range(n):
        x, y, w, h = rng.randint(-30, 400), rng.randint(-30, 300), rng.choice([8, 20, 60, 250]), rng.choice([8, 20, 60, 250])
        truth.append((rng.randint(1, 2), rng.randint(0, 3), rng.choice(["car", "bus"]), k, x, y, x + w, y + h))
    found = []
    for k, (c, p, name, box, *at) in enumerate(truth * 2):
        if rng.random() < 0.7:
            shift = rng.randint(0, 6)
            found.append((c, p, rng.choice([name, name, "car", "bike"]), k, at[0] + shift, at[1], at[2] + shift, at[3], rng.choice([0.2, 0.5, 0.5, 0.9, rng.random()])))
    return found, truth


def plain(found, truth):
    out = {}
    for name in {t[2] for t in truth}:
        n_truth = sum(t[2] == name for t in truth)
        own = sorted((f for f in found if f[2] == name), key=lambda f: (-f[8], f[0], f[1], f[3]))
        areas = []
        for least in evaluation.THRESHOLDS:
            asks = {}
            for f in own:
                near = [(iou(f[4:8], t[4:8]), -t[3]) for t in truth if t[:3] == f[:3]]
                if near and max(near)[0] >= least:
                    asks.setdefault(-max(near)[1], []).append((f[8], -f[3]))
            won = {-max(v)[1] for v in asks.values()}
            tp = np.cumsum([f[3] in won for f in own])
            if not len(own):
                areas.append(0.0)
                continue
            recall = np.concatenate([[0.0], tp / n_truth, [1.0]])
            precision = np.concatenate([[1.0], tp / np.arange(1, len(own) + 1), [0.0]])
            envelope = np.flip(np.maximum.accumulate(np.flip(precision)))
            levels = np.linspace(0, 1, 101)
            at = [int(np.flatnonzero(recall <= x + 1e-12)[-1]) for x in levels]
            y = [envelope[i] if i + 1 == len(recall) else envelope[i] + (envelope[i + 1] - envelope[i]) * (x - recall[i]) / (recall[i + 1] - recall[i]) for i, x in zip(at, levels)]
            areas.append(float(np.sum((np.array(y[1:]) + np.array(y[:-1])) / 2 * 0.01)))
        out[name] = (n_truth, len(own), areas[0], float(np.mean(areas)))
    return out


def measure(spark, found, truth):
    p, t = spark.createDataFrame(found, BOXES + ", score double"), spark.createDataFrame(truth, BOXES)
    keys = ["channel_id", "pic"]
    hit = evaluation.hits(p, t, keys)
    return {r.class_name: (r.n_truth, r.n_pred, r.ap50, r.ap50_95) for r in evaluation.average_precision(hit, t, keys).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_average_precision_equals_plain_interpolation(spark, seed):
    found, truth = scene(seed)
    found, truth = ([(*r[:4], *map(float, r[4:])) for r in side] for side in (found, truth))
    got, want = measure(spark, found, truth), plain(found, truth)
    assert got.keys() == want.keys()
    for name, row in want.items():
        assert got[name][:2] == row[:2] and np.allclose(got[name][2:], row[2:], atol=1e-9), name


def test_perfect_missing_and_wrong_predictions(spark):
    truth = [(1, 1, "car", k, 100.0 * k, 0.0, 100.0 * k + 50, 50.0) for k in range(4)] + [(1, 1, "bus", 9, 0.0, 0.0, 9.0, 9.0), (1, 1, "van", 8, 0.0, 0.0, 9.0, 9.0)]
    found = [(*t, 0.9 - 0.1 * t[3]) for t in truth[:4]] + [(1, 2, "van", 7, 0.0, 0.0, 9.0, 9.0, 0.8), (1, 2, "bike", 6, 0.0, 0.0, 9.0, 9.0, 0.8)]
    got = measure(spark, found, truth)
    assert got["bus"] == (1, 0, 0.0, 0.0) and got["van"] == (1, 1, 0.0, 0.0) and set(got) == {"car", "bus", "van"}
    assert abs(got["car"][2] - 0.995) < 1e-9  # the last level counts as missed, by definition of the end of the curve


def test_near_pairs_equal_all_pairs(spark):
    found, truth = scene(5, 200)
    a, b = ([(*r[:4], *map(float, r[4:8])) for r in side] for side in (found, truth))
    keys = ["channel_id", "pic"]
    df = [spark.createDataFrame(x, BOXES) for x in (a, b)]
    for least in (0.5, 0.75):
        got = {(r.box_a, r.box_b) for r in boxes.near_pairs(*df, keys, least).collect()}
        assert got == {(x[3], y[3]) for x in a for y in b if x[:2] == y[:2] and iou(x[4:], y[4:]) >= least} and got
    with pytest.raises(ValueError):
        boxes.near_pairs(*df, keys, 0.4)


def test_running_figures_over_one_key_equal_plain_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", None, "b"]), k, rng.choice([None, rng.randint(-5, 5)])) for k in range(500)]
    df = spark.createDataFrame(rows, "k string, at long, v long").repartition(6)
    got = {r["at"]: (r.s, r.m) for r in ranges.running(df, ["k"], [F.desc("at")], {"s": F.col("v")}, {"m": F.col("v")}).collect()}
    for key in ("hot", None, "b"):
        seen = []
        for _, at, v in sorted((r for r in rows if r[0] == key), key=lambda r: -r[1]):
            seen += [] if v is None else [v]
            assert got[at] == ((sum(seen), max(seen)) if seen else (None, None))


def test_heat_equals_painting(spark):
    rng = random.Random(2)
    rows = [(rng.randint(1, 2), rng.randint(1, 4), k // 3, k, rng.randint(-60, 130), rng.randint(-60, 90), rng.choice([0, 5, 33, 70]), rng.choice([5, 30])) for k in range(150)]
    df = spark.createDataFrame(rows, "channel_id long, track_id long, frame long, det_ord long, x long, y long, w long, h long")
    got = {(r.channel_id, r.u, r.v): r.heat for r in heat.motion(df, 10, 115, 80).collect()}
    cells = lambda r: {(x // 10, y // 10) for x in range(max(r[4], 0), min(r[4] + r[6], 115)) for y in range(max(r[5], 0), min(r[5] + r[7], 80))}
    want, last = Counter(), {}
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        if (r[0], r[1]) in last:
            want.update((r[0], u, v) for u, v in cells(r) ^ cells(last[r[0], r[1]]))
        last[r[0], r[1]] = r
    assert got == dict(want) and got
    assert heat.levels(heat.motion(df.limit(0))).count() == 0


def test_pair_figures_equal_all_pairs(spark):
    _, truth = scene(7, 80)
    rows = [(*r[:4], *map(float, r[4:8])) for r in truth] + [(5, 1, "car", 900, 0.0, 0.0, 10.0, 10.0), (5, 1, "car", 901, 8.0, 0.0, 18.0, 10.0), (6, 1, "car", 902, 0.0, 0.0, 1.0, 1.0)]
    got = {r.channel_id: (r.pairs, r.near, round(r.most, 9)) for r in boxes.pair_figures(spark.createDataFrame(rows, BOXES), "channel_id", ["channel_id", "pic"]).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        all_ = [iou(a[4:], b[4:]) for a in rows for b in rows if a[:2] == b[:2] == (c, a[1]) and a[3] < b[3]]
        if all_:
            want[c] = (len(all_), sum(x >= 0.5 for x in all_), round(max(all_), 9))
    assert got == want and got[5][1] == 0 and 6 not in got


def test_nearest_and_hits_equal_plain_matching(spark):
    found, truth = scene(11, 90)
    found, truth = ([(*r[:4], *map(float, r[4:])) for r in side] for side in (found, truth))
    p, t = spark.createDataFrame(found, BOXES + ", score double"), spark.createDataFrame(truth, BOXES)
    best = {}
    for f in found:
        near = [(iou(f[4:8], b[4:8]), -b[3]) for b in truth if b[:3] == f[:3] and iou(f[4:8], b[4:8]) >= 0.5]
        best[f[3]] = (-max(near)[1], max(near)[0]) if near else (None, None)
    got = {r.box: (r.box_b, r.iou) for r in boxes.nearest(p, t, ["channel_id", "pic", "class_name"]).collect()}
    assert got == best and any(v[0] is None for v in got.values())
    hit = evaluation.hits(p, t, ["channel_id", "pic"])
    for r in hit.collect():
        asks = [f for f in found if best[f[3]][0] is not None and best[f[3]][0] == best[r.box][0] and f[:3] == (r.channel_id, r.pic, r.class_name)]
        for k, least in enumerate(evaluation.THRESHOLDS):
            rivals = [f for f in asks if best[f[3]][1] >= least]
            assert r[f"tp_{k}"] == int(bool(rivals) and max(rivals, key=lambda f: (f[8], -f[3]))[3] == r.box)
