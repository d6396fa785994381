"""Nearest vectors in blocks and near hashes in bands, against all pairs."""

import random

import numpy as np
import pytest

from kerbside.operators import curation, vectors


@pytest.mark.parametrize("blocks", [(1000, 1000), (13, 3)])
def test_nearest_vectors_equal_all_distances(spark, blocks):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (120, 4)).astype(float)  # many ties and some vectors without length
    v[:30] = v[0] if v[0].any() else 1.0
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, vec array<float>")
    asked = df.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in vectors.nearest(df, asked, 5, *blocks).collect():
        got.setdefault(r.query_id, {})[r.k] = (r.vec_id, round(r.d, 9))
    for q in range(0, 120, 10):
        if not v[q].any():
            assert q not in got
            continue
        far = sorted((round(max(0.0, 1 - float(v[q] @ x) / float(np.linalg.norm(v[q]) * np.linalg.norm(x))), 9), k) for k, x in enumerate(v) if k != q and x.any())
        assert [got[q][k] for k in range(1, 6)] == [(k, pytest.approx(d, abs=2e-9)) for d, k in far[:5]]
    assert vectors.nearest(df, asked.limit(0), 5).count() == 0


@pytest.mark.parametrize("crowded", [0, 3, 1000])
def test_near_hashes_equal_all_pairs(spark, crowded):
    rng = random.Random(crowded)
    base = [rng.getrandbits(62) for _ in range(12)]
    rows = []
    for k in range(150):
        h = rng.choice(base)
        for _ in range(rng.randint(0, 4)):
            h ^= 1 << rng.randrange(62)
        rows.append((rng.choice([1, 1, 1, 2]), k, h))
    df = spark.createDataFrame(rows, "label int, name long, hash long")
    got = {(r.label, r.a, r.b) for r in curation.near_hashes(df, "label", "name", "hash", crowded=crowded).collect()}
    want = {(x[0], x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and bin(x[2] ^ y[2]).count("1") <= curation.NEAR_BITS}
    assert got == want and len(want) > 100


def test_copies_are_told_from_their_first_row(spark):
    rows = [(1, k, 77) for k in range(40)] + [(1, 100, 76), (1, 200, (1 << 40) - 1), (2, 300, 77), (1, 400, 77 ^ 0b11111 << 30)]
    df = spark.createDataFrame(rows, "label int, name long, hash long")
    got = {(r.label, r.node): r.root for r in curation.duplicates(df, "label", "name", "hash").collect()}
    assert got == {(1, k): 0 for k in [*range(40), 100, 400]}
