"""Many sources, waiting crops and resumable samples, as streams against batches."""

import random

import pytest
from pyspark.sql import functions as F

from kerbside.functions import geometry as G
from kerbside.operators import tracks
from kerbside.sources import detections as D
from kerbside.streaming import sources
from kerbside.streaming.pipelines import STATE_STORE

FRAMES = "frame long, arrived timestamp"


@pytest.fixture
def two_partitions(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def write(spark, path, k, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/part={k}")


@pytest.mark.parametrize("policy", ["max", "min"])
def test_a_stalled_source_loses_nothing(spark, tmp_path, two_partitions, policy):
    """Source 1 falls silent after a second and comes back after ten. With max, source 0 goes on meanwhile; with min, it waits."""
    import datetime as dt

    at = lambda ms: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(milliseconds=ms)
    zero = [(k, at(33 * k)) for k in range(400)]
    one = [(k, at(33 * k + 5)) for k in range(30)]
    back = [(30 + k, at(11_000 + 33 * k)) for k in range(40)]
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", policy)
    try:
        paths = [f"{tmp_path}/s{k}" for k in range(2)]
        for k in range(4):
            write(spark, paths[0], k, zero[k * 75 : (k + 1) * 75], FRAMES)
        write(spark, paths[1], 0, one, FRAMES)
        read = lambda k: spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(f"{paths[k]}/part=*")
        out = sources.batched(sources.together({0: read(0), 1: read(1)}, columns=["frame"]))
        start = lambda: out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        start().awaitTermination(120)
        seen = lambda: [(r.start, x.source_id, x.frame) for r in spark.read.parquet(f"{tmp_path}/out").collect() for x in r.frames]
        first = seen()
        if policy == "max":  # all but the last second of the faster source, whatever the other one does
            assert len([x for x in first if x[1] == 0]) >= 300 - 33
        else:
            assert len(first) < 2 * 40
        for k in (4, 5):
            write(spark, paths[0], k, zero[300 + (k - 4) * 50 : 350 + (k - 4) * 50], FRAMES)
        write(spark, paths[1], 4, back, FRAMES)
        write(spark, paths[0], 9, [(9999, at(60_000))], FRAMES)
        write(spark, paths[1], 9, [(9999, at(60_000))], FRAMES)
        start().awaitTermination(120)
        found = sorted((s, f) for _, s, f in seen() if f != 9999)
        assert found == sorted([(0, f) for f, _ in zero] + [(1, f) for f, _ in one + back])
    finally:
        spark.conf.unset("spark.sql.streaming.multipleWatermarkPolicy")


def test_batches_hold_the_sources_of_their_part(spark):
    rows = [(s, f, f * 33 + s % 3) for s in range(20) for f in range(5)]
    df = spark.createDataFrame(rows, "source_id long, frame long, ms long").withColumn("arrived", F.timestamp_millis("ms"))
    found = sources.batched(df).collect()
    assert len(found) == 5 * 3 and {(r.part, tuple(r.sources)) for r in found} == {(0, tuple(range(8))), (1, tuple(range(8, 16))), (2, tuple(range(16, 20)))}
    assert sources.batched(df.limit(0)).count() == 0


ASKED = "channel_id long, track_id long, frame long, pts_ms long, x long, y long, w long, h long, score double"
PICTURES = "channel_id long, frame long, pts_ms long, picture string, width long, height long"


def test_crops_of_a_stream_equal_the_batch_with_bounded_state(spark, tmp_path, two_partitions):
    """Pictures come with, after or never for their requests; what nobody will ask for any more leaves the state."""
    rng = random.Random(6)
    asked = [(c, t, f, f * 33, rng.randint(-20, 1900), rng.randint(-20, 1060), rng.randint(0, 90), rng.randint(5, 90), rng.random()) for f in range(600) for c in (1, 2) for t in range(2) if rng.random() < 0.4]
    pictures = [(c, f, f * 33, f"p{c}-{f}", 1920, 1080) for f in range(600) for c in (1, 2) if rng.random() < 0.7]
    end = 10_000_000
    late = lambda p: p[1] % 5 == 0  # noqa: E731  a third of a second behind the others: in the next file
    for k in range(6):
        write(spark, f"{tmp_path}/a", k, [a for a in asked if a[2] // 100 == k] + ([(9, 9, -1, end, 0, 0, 1, 1, 0.0)] if k == 5 else []), ASKED)
        own = [p for p in pictures if (p[1] + (100 if late(p) and p[1] % 100 > 90 else 0)) // 100 == k]
        write(spark, f"{tmp_path}/b", k, own + ([(9, -2, end, "end", 1, 1)] if k == 5 else []), PICTURES)
    for k in (6, 7):  # signs of life, by which the last requests are given up
        write(spark, f"{tmp_path}/a", k, [(9, 9, -k, end + k, 0, 0, 1, 1, 0.0)], ASKED)
        write(spark, f"{tmp_path}/b", k, [(9, -k - 9, end + k, "end", 1, 1)], PICTURES)
    write(spark, f"{tmp_path}/b", 8, [p for p in pictures if late(p) and p[1] % 100 > 90 and p[1] >= 500], PICTURES)
    read = lambda x, s: spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{x}/part=*")
    found = sources.crops(read("a", ASKED), read("b", PICTURES), 1000, "4 seconds")
    query = found.writeStream.format("memory").queryName("crops").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    most = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])
    left = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    got = {tuple(r) for r in spark.table("crops").collect() if r.channel_id != 9}
    served = [p for p in pictures if not (late(p) and p[1] % 100 > 90 and p[1] >= 500)]
    want = sources.crops(spark.createDataFrame(asked, ASKED), spark.createDataFrame(served, PICTURES), 1000)
    assert got == {tuple(r) for r in want.collect()}
    assert any(r[4] is None for r in got) and any(r[4] for r in got)
    assert most < (len(asked) + len(pictures)) * 0.6 and left <= 20


def test_crop_geometry_fills_half_of_its_scene(spark):
    import math

    boxes = [(500, 400, 100, 100), (500, 400, 120, 40), (500, 400, 40, 130), (500, 400, 200, 10), (-20, -10, 60, 40), (1900, 1070, 50, 90), (5, 5, 0, 9), (3000, 50, 20, 30), (10, 1040, 300, 90)]
    df = spark.createDataFrame(boxes, "x long, y long, w long, h long")
    cut = G.snapshot_crop(*[F.col(c) for c in "xywh"], F.lit(1920), F.lit(1080))
    for (x, y, w, h), r in zip(boxes, df.select(*[v.alias(k) for k, v in cut.items()]).collect()):
        if not w:
            assert r.side is None
            continue
        side, short = max(w, h), min(w, h)
        scene = min(short + 2 * math.ceil(short / 2), side)
        assert r.side == side
        if 0 <= x < x + side < 1920 and 0 <= y - side and y + side < 1080:  # nothing is cut off
            assert {r.src_x2 - r.src_x1, r.src_y2 - r.src_y1} == {side, scene}
            assert w * h * 2 >= side * scene - side
        if x < 1920:
            assert r.dst_x >= 0 and r.dst_x + r.src_x2 - r.src_x1 <= side and r.dst_y >= 0 and r.dst_y + r.src_y2 - r.src_y1 <= side


def test_requests_are_new_best_scores(spark):
    rows = [(1, 1, f, f * 33, 0, 0, w, 10, 0.5, True, f) for f, w in enumerate([10, 9, 12, 12, 30, 1])] + [(1, 1, 6, 200, 0, 0, 99, 99, 0.9, False, 6)]
    det = spark.createDataFrame(rows, "channel_id long, track_id long, frame long, pts_ms long, x long, y long, w long, h long, confidence double, in_roi boolean, det_ord long")
    assert sorted(r.frame for r in sources.requests(det).collect()) == [0, 2, 4]


VIDEO = "site string, video string, frame long, pts_ms long"


def test_a_stopped_run_of_samples_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    videos = {(f"s{k % 2}", f"v{k:02d}"): [(f"s{k % 2}", f"v{k:02d}", f, f * 40) for f in range(rng.randint(10, 200))] for k in range(7)}
    for k, rows in enumerate(list(videos.values())[:5]):
        write(spark, f"{tmp_path}/in", k, rows, VIDEO)
    stream = lambda: spark.readStream.schema(VIDEO).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/cp"
    kept, calls = sources.numbered, []

    def breaks(*a):
        calls.append(1)
        found = kept(*a)
        if len(calls) == 3:  # the third batch is written, and then the run dies before it is known to be done
            found.write.mode("overwrite").parquet(f"{out}/batch=2")
            raise RuntimeError("power cut")
        return found

    monkeypatch.setattr(sources, "numbered", breaks)
    with pytest.raises(Exception, match="power cut"):
        sources.sample_once(stream(), out, checkpoint).awaitTermination(120)
    monkeypatch.setattr(sources, "numbered", kept)
    sources.sample_once(stream(), out, checkpoint).awaitTermination(120)
    for k, rows in enumerate(list(videos.values())[5:], 5):
        write(spark, f"{tmp_path}/in", k, rows, VIDEO)
    sources.sample_once(stream(), out, checkpoint).awaitTermination(120)
    sources.sample_once(stream(), out, checkpoint).awaitTermination(120)  # nothing left to do
    found = sorted((r.site, r.number, r.video, r.slot, r.frame) for r in sources.read_samples(spark, out).collect())
    want = [(s, v, rows[f][3] // 1000, f) for (s, v), rows in videos.items() for f in range(len(rows)) if f % 25 == 0]
    assert sorted(x[:1] + x[2:] for x in found) == sorted(want)
    for site in ("s0", "s1"):
        assert [x[1] for x in found if x[0] == site] == list(range(1, sum(w[0] == site for w in want) + 1))


def test_best_crop_is_of_a_picture_that_came(spark):
    det = tracks.with_roi(D.detections(D.read_events(spark, "/root/testdata/sf0.001")), D.ROI)
    none = spark.createDataFrame([], PICTURES)
    assert sources.best_crops(sources.crops(sources.requests(det), none)).count() == 0
    assert sources.crops(sources.requests(det), none).count() == sources.requests(det).count() > 0
