"""The tracker, against exhaustive assignment and on clean motion."""

import itertools

import numpy as np

from kerbside.operators import tracker as T
from kerbside.streaming import tracking as live
from kerbside.streaming.pipelines import STATE_STORE


def test_assignment_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(200):
        cost = rng.random((rng.integers(1, 5), rng.integers(1, 5))).round(2)
        limit = 0.6
        got = T.assign(cost, limit)
        worth = lambda pairs: sum(limit - cost[i, j] for i, j in pairs)
        best = 0.0
        rows, cols = range(cost.shape[0]), range(cost.shape[1])
        for k in range(1, min(cost.shape) + 1):
            for a in itertools.combinations(rows, k):
                for b in itertools.permutations(cols, k):
                    if all(cost[i, j] <= limit for i, j in zip(a, b)):
                        best = max(best, worth(zip(a, b)))
        assert abs(worth(got) - best) < 1e-9
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)


def boxes(frame, *centres, score=0.9):
    corners = np.array([(x - 20, y - 15, x + 20, y + 15) for x, y in centres], float).reshape(-1, 4)
    return frame, np.arange(len(centres)) + frame * 10, corners, np.full(len(centres), score)


def test_two_vehicles_keep_their_numbers():
    frames = [boxes(f, (100 + 4 * f, 100), (500 - 4 * f, 300)) for f in range(40)]
    frames[20] = boxes(20, (180, 100))  # the second is missed once
    frames[25] = boxes(25, (200, 100), (400, 300), score=0.6)  # both are faint once
    found = T.follow(frames, T.Settings())
    assert {t for _, _, t in found} == {1, 2}
    assert {t for f, b, t in found if b == f * 10} == {1}
    assert sum(f == 25 for f, _, _ in found) == 2 and T.follow([boxes(0)], T.Settings()) == []


def test_a_track_moves_on_through_empty_frames():
    """A box at 12 pixels a frame, four frames without any, then back on its path."""
    frames = [boxes(f, *([] if 20 <= f < 24 else [(100 + 12 * f, 100)])) for f in range(40)]
    assert {t for _, _, t in T.follow(frames, T.Settings())} == {1}
    assert {t for _, _, t in T.follow([f for f in frames if len(f[1])], T.Settings())} == {1, 2}


def test_frames_without_boxes_reach_the_table_form(spark):
    schema = "channel_id long, frame long, box long, x1 double, y1 double, x2 double, y2 double, score double"
    rows = [(1, f, f, 80.0 + 12 * f, 85.0, 120.0 + 12 * f, 115.0, 0.9) for f in range(40) if not 20 <= f < 24]
    own = spark.createDataFrame(rows, schema)
    numbers = lambda df: len({r.track_id for r in df.collect()})
    assert numbers(T.track(own, frames=T.clock(own))) == 1 and numbers(T.track(own)) == 2
    assert T.track(own.limit(0), frames=T.clock(own.limit(0))).count() == 0


def test_stream_of_boxes_equals_the_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = []
    for c in (1, 2):
        for f in range(60):
            seen = [] if f % 13 in (5, 6) else [k for k in range(3) if rng.random() > 0.1]
            rows += [(c, f, c * 1000 + f * 10 + k, 50.0 + 90 * k + 5 * f, 80.0, 90.0 + 90 * k + 5 * f, 120.0, float(rng.choice([0.2, 0.4, 0.9]))) for k in seen]
            rows += [] if seen else [(c, f, None, None, None, None, None, None)]
    schema = "channel_id long, frame long, box long, x1 double, y1 double, x2 double, y2 double, score double"
    for k in range(4):
        spark.createDataFrame([r for r in rows if r[1] // 15 == k], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    query = live.tracks(stream).writeStream.format("memory").queryName("tracked").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("tracked").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    whole = spark.createDataFrame([r for r in rows if r[2] is not None], schema)
    want = T.track(whole, frames=spark.createDataFrame([r[:2] for r in rows], "channel_id long, frame long"))
    assert sorted(map(tuple, got)) == sorted((r.channel_id, r.frame, r.box, r.track_id) for r in want.collect()) and got


def test_tracks_by_channel(spark):
    rows = [(c, f, f * 10 + k, x - 20.0, 85.0, x + 20.0, 115.0, 0.9) for c in (1, 2) for f in [*range(30), *range(500, 520)] for k, x in enumerate((100.0 + f % 100, 400.0))]
    got = T.track(spark.createDataFrame(rows, "channel_id long, frame long, box long, x1 double, y1 double, x2 double, y2 double, score double")).collect()
    assert {(r.channel_id, r.track_id) for r in got} == {(c, n) for c in (1, 2) for n in (1, 2, 500_000_001, 500_000_002)}


def plain_follow(frames, high=0.25, low=0.1, buffer=150):
    """The tracker again, with matrices of its own and assignment by trying everything; for a few boxes a frame."""
    f_, p_, v_ = np.block([[np.eye(4), np.eye(4)], [np.zeros((4, 4)), np.eye(4)]]), 0.05, 0.00625
    h_ = np.eye(4, 8)
    scale = lambda x, p, v: np.diag([(x[2 + k % 2] * (p if k < 4 else v)) ** 2 for k in range(8)])
    tracked, lost, next_, now, out = [], [], 1, 0, []

    def iou(t, c):
        x = t["x"]
        a = (x[0] - x[2] / 2, x[1] - x[3] / 2, x[0] + x[2] / 2, x[1] + x[3] / 2)
        wide, tall = min(a[2], c[2]) - max(a[0], c[0]), min(a[3], c[3]) - max(a[1], c[1])
        both = max(wide, 0) * max(tall, 0)
        return both / ((a[2] - a[0]) * (a[3] - a[1]) + (c[2] - c[0]) * (c[3] - c[1]) - both + 1e-7)

    def match(own, at, limit, corners, scores):
        best = (0.0, ())
        for k in range(1, min(len(own), len(at)) + 1):
            for rows in itertools.combinations(range(len(own)), k):
                for cols in itertools.permutations(range(len(at)), k):
                    worth = [limit - (1 - iou(own[i], corners[at[j]]) * scores[at[j]]) for i, j in zip(rows, cols)]
                    if min(worth) >= 0 and sum(worth) > best[0] + 1e-12:
                        best = (sum(worth), tuple(zip(rows, cols)))
        return best[1]

    def correct(t, c, box):
        z = np.array([(c[0] + c[2]) / 2, (c[1] + c[3]) / 2, c[2] - c[0], c[3] - c[1]])
        s = h_ @ t["P"] @ h_.T + scale(t["x"], p_, 0)[:4, :4]
        gain = t["P"] @ h_.T @ np.linalg.inv(s)
        t.update(x=t["x"] + gain @ (z - h_ @ t["x"]), P=t["P"] - gain @ s @ gain.T, seen=now, active=True, box=box)

    for frame, boxes, corners, scores in frames:
        if not len(boxes):
            for t in tracked:
                t["P"] = f_ @ t["P"] @ f_.T + scale(t["x"], p_, v_)
                t["x"] = f_ @ t["x"]
            continue
        now += 1
        strong = [k for k, s in enumerate(scores) if s >= high]
        weak = [k for k, s in enumerate(scores) if low < s < high]
        young = [t for t in tracked if not t["active"]]
        pool = [t for t in tracked if t["active"]] + lost
        for t in pool:
            if t in lost:
                t["x"][6] = t["x"][7] = 0
            t["P"] = f_ @ t["P"] @ f_.T + scale(t["x"], p_, v_)
            t["x"] = f_ @ t["x"]
        pairs = match(pool, strong, 0.8, corners, scores)
        for i, j in pairs:
            correct(pool[i], corners[strong[j]], boxes[strong[j]])
        free = [k for j, k in enumerate(strong) if j not in {y for _, y in pairs}]
        rest = [t for i, t in enumerate(pool) if i not in {x for x, _ in pairs} and t not in lost]
        again = match(rest, weak, 0.5, corners, scores)
        for i, j in again:
            correct(rest[i], corners[weak[j]], boxes[weak[j]])
        third = match(young, free, 0.7, corners, scores)
        for i, j in third:
            correct(young[i], corners[free[j]], boxes[free[j]])
        new = []
        for k in (k for j, k in enumerate(free) if j not in {y for _, y in third}):
            if scores[k] >= high:
                c = corners[k]
                x = np.array([(c[0] + c[2]) / 2, (c[1] + c[3]) / 2, c[2] - c[0], c[3] - c[1], 0, 0, 0, 0])
                new.append({"id": next_, "x": x, "P": scale(x, 2 * p_, 10 * v_), "start": now, "seen": now, "active": now == 1, "box": boxes[k]})
                next_ += 1
        every = [t for t in pool + young if t["seen"] == now] + new
        lost = [t for t in pool if t["seen"] != now and now - t["seen"] <= buffer]
        place = lambda t: (t["x"][0] - t["x"][2] / 2, t["x"][1] - t["x"][3] / 2, t["x"][0] + t["x"][2] / 2, t["x"][1] + t["x"][3] / 2)
        drop = []
        for t in every:
            for u in lost:
                if 1 - iou(t, place(u)) < 0.15:
                    drop.append(u["id"] if t["seen"] - t["start"] > u["seen"] - u["start"] else t["id"])
        tracked, lost = ([t for t in side if t["id"] not in drop] for side in (every, lost))
        out += [(frame, int(t["box"]), t["id"]) for t in tracked if t["active"]]
    return out


def test_tracks_agree_with_a_plain_tracker_at_borderline_scores():
    rng = np.random.default_rng(12)
    for case in range(25):
        frames, number = [], 0
        speed = rng.normal(0, 3, (4, 2))
        at = rng.uniform(60, 200, (4, 2))
        for f in range(30):
            seen = [] if rng.random() < 0.12 else [k for k in range(4) if rng.random() > 0.15]
            centres = at + speed * f + rng.normal(0, 2, (4, 2))
            size = rng.uniform(18, 26, (4, 2))
            corners = np.concatenate([centres - size, centres + size], 1)[seen]
            scores = rng.choice([0.1, 0.2, 0.25, 0.2501, 0.3, 0.6, 0.9], len(seen), p=[0.05, 0.1, 0.1, 0.1, 0.15, 0.2, 0.3])
            frames.append((f, np.arange(number, number + len(seen)), corners, scores))
            number += len(seen)
        got = T.follow(frames, T.Settings())
        assert sorted(got) == sorted(plain_follow(frames)), case
