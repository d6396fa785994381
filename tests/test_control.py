"""Phases: the batch against a plain machine, the stream against the batch, however rows and commands come in."""

import random

import pytest
from pyspark.sql import functions as F

from kerbside.operators import control
from kerbside.streaming import control as live
from kerbside.streaming.pipelines import STATE_STORE

ROWS = "channel_id long, pts_ms long, det_ord long"


def script(seed, n=120):
    rng = random.Random(seed)
    rows = [(rng.randint(1, 3), 33 * rng.randint(0, 200), k) for k in range(n)]
    actions = [control.ADD, control.SETUP, control.ANALYTICS, control.ANALYTICS, control.REVIEW, control.REMOVE]
    commands = [(c, rng.randint(0, 1500), c, control.ADD) for c in (1, 2)] + [(rng.randint(1, 3), rng.choice([33 * rng.randint(0, 200), rng.randint(0, 6600)]), 10 + k, rng.choice(actions)) for k in range(25)]
    return rows, commands


def plain(rows, commands):
    """One event after the other, in the order of time, commands first."""
    machines, out, moved = {}, [], []
    events = [(c, p, 0, n, a) for c, p, n, a in commands] + [(c, p, 1, n, None) for c, p, n in rows]
    for channel, at, kind, number, action in sorted(events, key=lambda e: (e[0], e[1], e[2], e[3])):
        m = machines.setdefault(channel, live.Phases())
        if kind == 0:
            old = m.command(at, action)
            if old:
                moved.append((channel, at, old, m.phase))
        elif m.phase in (control.SETUP, control.ANALYTICS):
            out.append((channel, at, number, m.phase, m.epoch, at - m.start))
    return sorted(out), sorted(moved)


@pytest.mark.parametrize("seed", range(4))
def test_batch_equals_the_plain_machine(spark, seed):
    rows, commands = script(seed)
    r, c = spark.createDataFrame(rows, ROWS), spark.createDataFrame(commands, live.COMMANDS)
    want, moved = plain(rows, commands)
    assert sorted(map(tuple, control.phased(r, c).collect())) == want and want
    assert sorted((x.channel_id, x.pts_ms, x.old_phase, x.phase) for x in control.changes(c).collect()) == moved


def test_slices_do_not_show(spark, monkeypatch):
    rows, commands = script(9)
    monkeypatch.setattr(control, "SLICE_MS", 50)
    found = control.phased(spark.createDataFrame(rows, ROWS), spark.createDataFrame(commands, live.COMMANDS))
    assert sorted(map(tuple, found.collect())) == plain(rows, commands)[0]


@pytest.mark.parametrize("seed,row_cuts,command_cuts", [(1, 4, 1), (2, 2, 3), (3, 1, 5)])
def test_stream_equals_batch_whatever_the_batches(spark, tmp_path, seed, row_cuts, command_cuts):
    """Commands come before, with or long after the rows they stand between; both end with a sign of life far ahead."""
    rows, commands = script(seed)
    end = 10_000_000
    sides = {"rows": ([*rows, (99, end, -1)], ROWS, row_cuts), "commands": ([*commands, (99, end, -1, None)], live.COMMANDS, command_cuts)}
    streams = {}
    for name, (data, schema, cuts) in sides.items():
        data.sort(key=lambda x: x[1])
        for k in range(cuts):
            part = data[k * len(data) // cuts : (k + 1) * len(data) // cuts]
            random.Random(k).shuffle(part)
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/part={k}")
        streams[name] = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/part=*")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    found = live.phased(streams["rows"], streams["commands"], "10 seconds")
    query = found.writeStream.format("memory").queryName(f"phased{seed}").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    got = spark.table(f"phased{seed}").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, moved = plain(rows, commands)
    assert sorted((x.channel_id, x.pts_ms, x.det_ord, x.phase, x.epoch, x.epoch_ms) for x in got if x.det_ord is not None) == want
    assert sorted((x.channel_id, x.pts_ms, x.old_phase, x.phase) for x in got if x.old_phase is not None) == moved


def test_empty_inputs(spark):
    none = spark.createDataFrame([], live.COMMANDS)
    assert control.phased(spark.createDataFrame([(1, 5, 1)], ROWS), none).count() == 0
    assert control.phased(spark.createDataFrame([], ROWS), spark.createDataFrame([(1, 0, 1, control.ADD)], live.COMMANDS)).count() == 0
    assert control.effective(none).where(F.col("epoch") > 0).count() == 0
