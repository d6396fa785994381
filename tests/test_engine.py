"""The engines give the same where both see the same, and the service answers odd requests."""

import pytest
from pyspark.sql import functions as F

from kerbside import engine
from kerbside.operators import comparison, service
from kerbside.sources import detections as D
from kerbside.streaming.control import COMMANDS
from kerbside.streaming.pipelines import STATE_STORE

SITE = [(a, x1, y1, x2, y2, s) for a, x1, y1, x2, y2, s in D.ARMS]


@pytest.fixture
def stream_of(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def of(df, name, by, cuts):
        for k, (lo, hi) in enumerate(zip(cuts, [*cuts[1:], 1 << 60])):
            df.where((F.col(by) >= lo) & (F.col(by) < hi)).coalesce(1).write.parquet(f"{tmp_path}/{name}/part={k}")
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/part=*")

    yield of
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def result(spark, df, name):
    df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(180)
    return spark.table(name)


def rows_of(df, names):
    return sorted(str([r[c] for c in names]) for r in df.select(*names).collect())


def test_engines_are_swapped_by_name(spark, stream_of):
    det = D.detections(D.read_events(spark, "/root/testdata/sf0.001"), piece=30)
    boxes = det.selectExpr("channel_id", "frame", "det_ord AS box", "x AS x1", "y AS y1", "x + w AS x2", "y + h AS y2", "confidence AS score")
    boxes = boxes.withColumns({c: F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")})
    commands = spark.createDataFrame([(c, 0, c, "add") for c in range(3)] + [(1, 900, 9, "analytics"), (2, 1500, 10, "review"), (0, 10**9, 99, None)], COMMANDS)
    rows = det.select("channel_id", "pts_ms", "det_ord").unionByName(spark.createDataFrame([(0, 10**9, -1)], "channel_id long, pts_ms long, det_ord long"))
    batch, live = (engine.engine(name, SITE, D.ROI, stagnant_frames=20) for name in ("batch", "stream"))
    names = ["channel_id", "track_id", "frame", "arm_id", "direction", "kind"]
    got = result(spark, live.crossings(stream_of(det, "det", "frame", [0, 30, 60])), "engine_crossings")
    assert rows_of(got, names) == rows_of(batch.crossings(det), names) and got.count() > 0
    names = ["channel_id", "frame", "box", "track_id"]
    got = result(spark, live.tracks(stream_of(boxes, "boxes", "frame", [0, 40])), "engine_tracks")
    assert rows_of(got, names) == rows_of(batch.tracks(boxes), names)
    names = ["channel_id", "pts_ms", "det_ord", "phase", "epoch", "epoch_ms"]
    live.lateness = "1 hour"
    got = result(spark, live.phased(stream_of(rows, "rows", "pts_ms", [0, 1000]), stream_of(commands, "commands", "pts_ms", [0])), "engine_phased")
    assert rows_of(got.where("det_ord >= 0"), names) == rows_of(batch.phased(rows, commands).where("det_ord >= 0"), names)
    assert set(batch.alerts(det).columns) == {x.split()[0] for x in engine.schemas.ALERTS.split(", ")}
    with pytest.raises(ValueError, match="no engine"):
        engine.engine("gpu", SITE)


def test_snapshots_of_odd_requests(spark):
    schema = "channel long, track_id long, picture string"
    hot = spark.createDataFrame([(2, 7, "h2"), (1, 7, "h1"), (1, 8, "h8")], schema)
    cold = spark.createDataFrame([(1, 8, "c8"), (3, 9, "c9"), (2, 9, "c9b")], schema)
    asked = spark.createDataFrame(list(enumerate(["7", " 8 ", "9", "10", "x", "", None, "9" * 30, "-7"])), "request_id long, track string")
    got = {r.request_id: (r.status, r.picture) for r in service.snapshots(asked, hot, cold).collect()}
    assert got == {0: (200, "h1"), 1: (200, "h8"), 2: (200, "c9b"), 3: (404, None), 4: (400, None), 5: (400, None), 6: (400, None), 7: (400, None), 8: (404, None)}


def test_phase_requests_are_checked_in_order(spark):
    states = spark.createDataFrame([(1, "setup"), (2, "analytics")], "channel long, phase string")
    rows = [(0, 1, "analytics", 4, ["a", "b"]), (1, 1, "analytics", 2, ["a", "b"]), (2, 1, "analytics", 4, ["a", "a"]), (3, 1, "analytics", None, None), (4, 9, "review", 4, []), (5, 9, "nap", 4, []),
            (6, 1, None, 4, []), (7, 2, "analytics", 0, ["a", "a"]), (8, 2, "review", None, None), (9, 1, "analytics", 3, None), (10, None, "setup", 3, None)]
    asked = spark.createDataFrame(rows, "request_id long, channel long, phase string, corners long, labels array<string>")
    got = {r.request_id: r.status for r in service.phase_changes(asked, states).collect()}
    assert got == {0: 200, 1: 422, 2: 422, 3: 422, 4: 404, 5: 422, 6: 422, 7: 200, 8: 200, 9: 200, 10: 404}


def test_jobs_of_a_cleaned_channel_have_time_to_end(spark):
    jobs = spark.createDataFrame([("a", 1, 0, 50, False), ("b", 1, 0, 6000, False), ("c", 1, 0, None, False), ("d", 2, 0, 50, True), ("e", 2, 0, 900, False), ("f", 2, 500, 600, False)], "alert_id string, channel long, submitted_ms long, finished_ms long, failed boolean")
    clean = spark.createDataFrame([(1, 90), (2, 1000)], "channel long, at_ms long")
    got = {r.alert_id: (r.state, r.drained) for r in service.job_status(jobs, clean, 100).collect()}
    assert got == {"a": (None, True), "b": (None, False), "c": (None, False), "d": ("failed", None), "e": ("pending", None)}


def test_teachers_without_a_box_and_without_a_picture(spark):
    schema = "teacher string, site string, stem string, box long, x1 double, y1 double, x2 double, y2 double, score double"
    none = (None,) * 6
    rows = [("base", "s", "f1", 1, 0.0, 0.0, 10.0, 10.0, 0.5), ("base", "s", "f2", *none), ("new", "s", "f1", *none), ("new", "s", "f3", 1, 0.0, 0.0, 10.0, 0.0, 0.5)]
    plan = spark.createDataFrame([("s", "f1"), ("s", "f2"), ("s", "f3")], "site string, stem string")
    got = {r.teacher: r for r in comparison.dashboard(plan, spark.createDataFrame(rows, schema), "base", 10, 10).collect()}
    assert (got["base"].total, got["base"].with_boxes, got["base"].empty, got["base"].missing) == (1, 1, 1, 1) and got["base"].areas == "0,0,0,0,0,0,1"
    assert (got["new"].matched, got["new"].missed, got["new"].extra, got["new"].rate) == (0, 1, 0, 0.0) and got["base"].matched is None
    assert got["new"].aspects == "0,0,0,0,0,0,0" and got["new"].sites == "s:1/2=0.5"
