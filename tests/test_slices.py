"""Slices of time give what one walk gives: stitching and rate caps."""

import random

import pytest
from pyspark.sql import functions as F

from kerbside.operators import sequences, stitch, tracks
from kerbside.sources import detections as D

SEGMENTS = (
    "channel_id long, track_id long, seg_id long, first_frame long, first_ord long, last_frame long, first_cx long, first_cy long, last_cx long, last_cy long,"
    " before_frame long, before_cx long, before_cy long, roi_at_end boolean"
)


def segments(seed, n=250, span=3000):
    """Many short segments close together, some of one row, some again under an old id."""
    rng, rows = random.Random(seed), []
    for k in range(n):
        first = rng.randint(0, span)
        last = first + rng.choice([0, 0, 1, 5, 40, 400])
        x, y = rng.randint(0, 250), rng.randint(0, 250)
        steps = (None, None, None) if last == first else (last - 1, x + rng.randint(-6, 6), y + rng.randint(-6, 6))
        rows.append((rng.choice([1, 1, 1, 2]), rng.randint(0, n // 3), k, first, k, last, rng.randint(0, 250), rng.randint(0, 250), x, y, *steps, rng.random() < 0.9))
    return rows


def one_walk(rows):
    names = [x.split()[0] for x in SEGMENTS.split(", ")]
    out = {}
    for channel in {r[0] for r in rows}:
        own = [dict(zip(names, r)) for r in rows if r[0] == channel]
        end = max(r["last_frame"] for r in own)
        own = [{**r, "channel_end": end, "starts": True, "leaves": r["last_frame"] < end} for r in own]
        facts, _ = stitch.match(own)
        fate = {r["seg_id"]: {} for r in own}
        for f in facts:
            fate[f["seg_id"]].update(f)
        for r in own:
            root, f = r["seg_id"], fate[r["seg_id"]]
            while "prev_seg" in fate[root]:
                root = fate[root]["prev_seg"]
            out[channel, r["seg_id"]] = (root, f.get("prev_seg"), f.get("distance"), f.get("gap_frames"), f.get("lost_frame"), f.get("final_frame"))
    return out


@pytest.mark.parametrize("seed,frames", [(1, 400), (2, 70), (3, 100), (4, 1000)])
def test_a_channel_in_slices_equals_one_walk(spark, seed, frames):
    rows = segments(seed)
    want = one_walk(rows)
    found = stitch.stitch(spark.createDataFrame(rows, SEGMENTS), frames=frames).collect()
    assert {(r.channel_id, r.seg_id): tuple(r)[2:] for r in found} == want and len(found) == len(rows)
    assert sum(v[1] is not None for v in want.values()) > 20


def test_a_slice_must_outlast_what_is_lost(spark):
    with pytest.raises(ValueError):
        stitch.stitch(spark.createDataFrame([], SEGMENTS), frames=61)
    assert stitch.stitch(spark.createDataFrame([], SEGMENTS)).count() == 0


def test_derived_tracks_in_eight_slices(spark):
    rows = tracks.with_segments(tracks.with_roi(D.detections(D.read_events(spark, "/root/testdata/sf0.01"), piece=7), D.ROI))
    own = tracks.segments(rows)
    whole, cut = (sorted(map(str, stitch.stitch(own, frames=f).collect())) for f in (stitch.SLICE, 90))
    assert whole == cut and len(whole) > 1000


@pytest.mark.parametrize("slice_ms", [20, 100, 1000, 60_000])
def test_rate_cap_in_slices_equals_one_walk(spark, slice_ms):
    rng = random.Random(slice_ms)
    rows, keep = [], set()
    for key in ((1, 1), (1, 2), (None, 1), (3, 1)):
        t, last = rng.randint(0, 500), None
        for n in range(400):
            t += rng.choice([0, 1, 8, 16, 16, 17, 33, 40, 300])
            rows.append((*key, n, t))
            if last is None or t - last >= 1000.0 / 30 - 1:
                last = t
                keep.add((*key, t))
    df = spark.createDataFrame(rows, "channel_id long, epoch long, n long, pts_ms long").repartition(5)
    got = sequences.rate_cap(df, ["channel_id", "epoch"], "pts_ms", 30.0, slice_ms).collect()
    assert sorted(((r.channel_id, r.epoch, r.pts_ms) for r in got), key=str) == sorted(keep, key=str)
    assert sequences.rate_cap(df.where(F.lit(False)), "channel_id", "pts_ms", 30.0).count() == 0
