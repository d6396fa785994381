"""Streams give what batches give on the same rows."""

import itertools

import pytest
from pyspark.sql import functions as F

from kerbside import schemas
from kerbside.operators import direction, tracks
from kerbside.sources import detections as D
from kerbside.streaming import alerts, pipelines


def run(spark, df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_crossings_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    det = tracks.with_roi(D.detections(D.read_events(spark, "/root/testdata/sf0.001")), D.ROI)
    rows = det.select("channel_id", "track_id", "frame", "det_ord", "cx", "cy", "in_roi")
    # four files by time: a batch each
    for k in range(4):
        rows.where(F.floor(F.col("frame") / 25) == k).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", pipelines.STATE_STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    arms = [(a, x1, y1, x2, y2, s) for a, x1, y1, x2, y2, s in D.ARMS]
    got = run(spark, pipelines.crossings(stream, arms), "crossed").drop("seg_id")
    want = tracks.crossings(tracks.with_segments(det), D.arms(spark)).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.where("frame < 100").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_stats_and_watchdog(spark, tmp_path):
    events = D.read_events(spark, "/root/testdata/sf0.001")
    events.coalesce(1).write.parquet(f"{tmp_path}/ev")
    stream = lambda: spark.readStream.schema(events.schema).parquet(f"{tmp_path}/ev")
    got = run(spark, pipelines.stats(stream(), "event_type", "ts", "value", "1 day", "1 hour"), "stats", "complete")
    want = events.groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 day").start.alias("start")).count()
    assert {(r.event_type, r.start, r.n) for r in got.collect()} == {(r.event_type, r.start, r["count"]) for r in want.collect()}
    silent = run(spark, pipelines.watchdog(stream(), "user_id", "ts", "12 hours", "1 hour"), "silent")
    assert silent.count() > 0


NAMES = [x.split()[0] for x in schemas.ALERTS.split(", ")]
ARMS = [(a, x1, y1, x2, y2, s) for a, x1, y1, x2, y2, s in D.ARMS]


@pytest.mark.parametrize("piece", [30, 7, 0])
def test_alerts_frame_by_frame_equal_the_batch(spark, piece):
    """One channel after the other, frame by frame in plain Python, against windows, stitching and the sorted walk."""
    det = tracks.with_roi(D.detections(D.read_events(spark, "/root/testdata/sf0.01"), piece=piece), D.ROI).where("channel_id < 2")
    rows = sorted((r.asDict() for r in det.collect()), key=lambda r: (r["channel_id"], r["frame"], r["det_ord"]))
    want = []
    for key, own in itertools.groupby(rows, key=lambda r: r["channel_id"]):
        channel = alerts.Channel(key, ARMS, 20)
        want += [*channel.frame(own), *channel.end()]
    got = direction.alerts(det.drop("in_roi"), D.arms(spark), D.ROI, 20).collect()
    assert sorted(map(str, ([r[c] for c in NAMES] for r in got))) == sorted(map(str, ([r[c] for c in NAMES] for r in want)))
    kinds = {(r["type"], r["method"]) for r in want}
    assert ("stagnant", None) in kinds and any(kind == "transit" for kind, _ in kinds)


def test_alerts_of_a_stream_equal_those_of_the_plain_walk(spark, tmp_path):
    det = tracks.with_roi(D.detections(D.read_events(spark, "/root/testdata/sf0.001"), piece=30), D.ROI)
    rows = det.select("channel_id", "track_id", "class_name", "frame", "det_ord", "pts_ms", "cx", "cy", "in_roi")
    for k in range(3):
        rows.where(F.least(F.floor(F.col("frame") / 60), F.lit(2)) == k).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", pipelines.STATE_STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    got = [r.asDict() for r in run(spark, alerts.alerts(stream, ARMS, 20), "alerts").collect()]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    order = sorted((r.asDict() for r in rows.collect()), key=lambda r: (r["channel_id"], r["frame"], r["det_ord"]))
    want = []
    for key, own in itertools.groupby(order, key=lambda r: r["channel_id"]):
        want += alerts.Channel(key, ARMS, 20).frame(own)
    text = lambda rs: sorted(str([None if r[c] != r[c] else r[c] for c in NAMES]) for r in rs)
    assert text(got) == text(want) and want


def test_settings_take_effect_between_batches_and_reach_all_sinks(spark):
    det = spark.createDataFrame([(1, 0.4), (1, 0.6), (2, 0.3), (2, 0.2), (3, 0.9)], "channel_id long, confidence double")
    settings = {"now": [(1, 0.5)]}
    seen: dict[str, list] = {"a": [], "b": []}
    sinks = {k: (lambda df, k=k: seen[k].append(sorted(map(tuple, df.collect())))) for k in seen}
    write = pipelines.with_settings(
        det, lambda: spark.createDataFrame(settings["now"], "channel_id long, threshold double"), lambda df: pipelines.fan_out(sinks)(df, 0)
    )
    write(det, 0)
    settings["now"] = [(1, 0.3), (3, 0.95)]
    write(det, 1)
    assert seen["a"] == seen["b"] == [[(1, 0.6), (2, 0.3), (3, 0.9)], [(1, 0.4), (1, 0.6), (2, 0.3)]]


def two_channels():
    """Channel 1 ends at frame 60, with a vehicle lost on its way; channel 2 goes on to frame 400."""
    row = lambda c, t, f, x, y: (c, t, "car", f, c * 100_000 + f * 10 + t, f * 33, x, y, True)
    rows = [row(1, 1, f, 1580 + 2 * f, 400) for f in range(40)]  # leaves across the eastern arm
    rows += [row(1, 2, f, 700 + 8 * f, 300 + 12 * f) for f in range(30)] + [row(1, 3, f, 900, 500) for f in range(60)]
    rows += [row(2, 4, f, 400 + f % 7, 400) for f in range(400)] + [row(2, 5, f, 310 - 2 * f, 500) for f in range(30)] + [row(2, 6, 2 * f, 800, 800) for f in range(50)]
    return rows


ROWS = "channel_id long, track_id long, class_name string, frame long, det_ord long, pts_ms long, cx long, cy long, in_roi boolean"


def test_a_silent_channel_gives_its_alerts(spark, tmp_path):
    rows = two_channels()
    for k in range(5):
        spark.createDataFrame([r for r in rows if r[3] // 80 == k], ROWS).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", pipelines.STATE_STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    got = run(spark, alerts.alerts(stream, ARMS, 20, lateness="1 second"), "silent_channel").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = []
    for key in (1, 2):
        channel = alerts.Channel(key, ARMS, 20)
        own = [dict(zip([x.split()[0] for x in ROWS.split(", ")], r)) for r in sorted(rows, key=lambda r: (r[3], r[4])) if r[0] == key]
        want += [*channel.frame(own), *channel.pass_((399 * 33 - 1000) // 33)]
    plain = lambda r: str([None if r[c] != r[c] else r[c] for c in NAMES])
    assert sorted(map(plain, got)) == sorted(map(plain, want))
    late = [r for r in want if r["channel_id"] == 1 and r["frame"] > 60]
    assert late, "the silent channel has an alert after its last row"


class Store:
    """A map or value state in a dict that counts what is written."""

    def __init__(self):
        self.held, self.written = {}, 0

    def iterator(self):
        return iter(dict(self.held).items())

    def containsKey(self, k):
        return k in self.held

    def getValue(self, k):
        return self.held[k]

    def updateValue(self, k, v):
        self.held[k] = v
        self.written += sum(len(x) for x in v if isinstance(x, bytes))

    def removeKey(self, k):
        self.held.pop(k, None)

    def exists(self):
        return 0 in self.held

    def get(self):
        return self.held[0]

    def update(self, v):
        self.held[0] = v


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Store())

    def getValueState(self, name, *_):
        return self.states.setdefault(name, Store())

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def test_a_batch_writes_the_tracks_it_changed():
    import pandas as pd

    names = [x.split()[0] for x in ROWS.split(", ")]
    processor, handle = alerts.AlertProcessor(ARMS, 20, 33), Handle()
    processor.init(handle)
    feed = lambda rows: list(processor.handleInputRows((1,), iter([pd.DataFrame(rows, columns=names)]), None))
    feed([(1, t, "car", f, f * 1000 + t, f * 33, 10 * t, 500, True) for f in range(40) for t in range(200)])
    active = handle.states["active"]
    whole, active.written = active.written, 0
    assert len(active.held) == 200 and handle.timers == {(39 + 62) * 33 + 1}
    feed([(1, t, "car", 39, 39_900 + t, 39 * 33, 10 * t, 500, True) for t in range(2)])
    assert 0 < active.written <= whole / 50 and len(active.held) == 200
    # a timer gives all of them up, and nothing is left to wait for
    values = type("T", (), {"getCurrentWatermarkInMs": lambda self: 33 * 500 + 1})()
    info = type("I", (), {"getExpiryTimeInMs": lambda self: (39 + 62) * 33 + 1})()
    list(processor.handleExpiredTimer((1,), values, info))
    assert not active.held and not handle.states["lost"].held and handle.states["clock"].get() == (500, None)
