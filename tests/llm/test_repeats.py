"""Exact-substring deduplication, against counting all strings."""

import random
from collections import Counter

import numpy as np

from kerbside.llm import repeats


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(t[k : k + length] for _, t in data for k in range(len(t) - length + 1))
    out = []
    for i, t in data:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((i, len(t), int(gone.sum()), runs, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, rows = text(150), []
    for k in range(60):
        t = text(rng.randint(0, 200))
        if k % 3 == 0:
            at = rng.randint(0, 60)
            t = text(rng.randint(0, 50)) + passage[at : at + rng.randint(20, 150)] + t
        if k % 10 == 0:
            t = t + text(5) + t
        rows.append((k, t))
    rows += [(100 + k, rows[k][1]) for k in range(0, 20, 4)]
    rows += [(200 + k, "".join(c if rng.random() > 0.02 else "z" for c in rows[k][1])) for k in range(0, 40, 3)]
    return rows + [(300, "y" * 90), (301, "ab" * 60), (302, None), (303, "")]


def run(docs, length, **how):
    found = repeats.deduplicate(docs, length, piece=8, **how).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found), key=str)


def test_equal_to_brute_force_by_expansion_and_by_counting(make):
    rows = corpus()
    want = brute(rows, 40)
    assert sum(r[2] for r in want) > 1000
    assert run(make(rows), 40) == want
    assert run(make(rows), 40, hulls=1) == want


def test_odd_rows(make, odd):
    from tests.llm.conftest import ODD

    rows = [*enumerate(ODD), (5, ODD[5]), (None, "no id")]
    assert run(odd, 16) == brute(rows, 16)
    assert repeats.deduplicate(make([])).count() == 0


def test_long_texts_are_read_in_parts(monkeypatch):
    monkeypatch.setattr(repeats, "PART", 100)
    rng = random.Random(1)
    text = "".join(rng.choice("ab") for _ in range(1000)).encode()
    found = list(repeats.anchors(text, 40, 8))
    starts = [s for _, _, a, b in found for s in range(a, b + 1)]
    assert starts == list(range(len(text) - 39))
