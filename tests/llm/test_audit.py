"""The filter audit against every order applied row by row."""

import itertools
import random
import re

import numpy as np

from kerbside.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    fails = []
    for i, text, source in rows:
        text = text or ""
        w = WORD.findall(text)
        f = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > least[text],
        }
        fails.append((i, source or "", {k for k, v in f.items() if v}))
    out = {}
    for part in {p for _, p, _ in fails}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [(i, f) for i, p, f in fails if p == part]
            all_ = list(left)
            for step, own in enumerate(order, 1):
                here = [(i, f) for i, f in left if own in f]
                left = [(i, f) for i, f in left if own not in f]
                shapley[own] += len(here)
                out[part, order, step] = [
                    len(left), len(here), sum(own in f for _, f in all_) - len(here), sum(f == {own} for _, f in all_),
                    sum(i in good for i, _ in here), sum(i in toxic for i, _ in here), own,
                ]
        for (p, _, _), v in out.items():
            if p == part:
                v[6] = shapley[v[6]]
    return {k: tuple(v) for k, v in out.items()}


def check(spark, rows, labels, parts=3):
    full = [(i, t, "en", s, len(t or ""), "clash", 7, "x") for i, t, s in rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, words string, mask int, part string")
    marks = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, part string")
    found = audit.interactions(docs.repartition(parts), marks).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in audit.COUNTS) for r in found}
    assert len(got) == len(found)
    assert got == brute(rows, labels)


def texts(rng, n):
    pool = ["alpha", "Beta", "GAMMA", "delta", "é", "x#y", "100%", "one", "two"]
    own = lambda: " ".join(rng.choice(pool[: rng.randint(1, 9)]) + (str(rng.randint(0, 400)) if rng.random() < 0.6 else "") for _ in range(rng.choice([5, 199, 200, 320])))
    return [own() for _ in range(n)]


def test_all_orders_equal_brute_force(spark):
    rng = random.Random(2)
    held = texts(rng, 30)
    rows = [(k, rng.choice(held), rng.choice(["a", "b", "c"])) for k in range(70)]
    check(spark, rows, [(k, rng.randint(0, 1), rng.randint(0, 1)) for k in range(0, 80, 2)])


def test_odd_rows(spark):
    long_ = "Word " * 30_000
    rows = [(1, None, None), (2, "", ""), (3, " \t\n", "b"), (None, "same", "b"), (None, "same", None), (4, "same", "b"), (4, "same", "b"), (4, "same", "a"),
            (5, "same", "a"), (6, long_, "a"), (7, long_, "b"), (8, "no break\u00a0space \u2003 #", "b"), (-1, "same", "a")]
    check(spark, rows, [(4, 1, 0), (4, 0, 1), (5, None, 1), (None, 1, 1), (99, 1, 1)])
    check(spark, rows, [])


def test_empty_tables(spark):
    check(spark, [], [(1, 1, 1)])
    check(spark, [], [])


def test_one_text_in_most_rows(spark):
    rows = [(k, "copy of copies", "hot" if k % 3 else "b") for k in range(600)] + [(1000 + k, f"text {k}", "hot") for k in range(100)]
    check(spark, rows, [(k, 1, 0) for k in range(0, 600, 7)], parts=7)


def test_swaps_visit_each_order_once():
    for n in range(1, 7):
        order = list(range(n))
        seen = [tuple(order)]
        for k in audit.swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.append(tuple(order))
        assert sorted(seen) == sorted(itertools.permutations(range(n)))


def test_a_swap_counts_two_steps_anew(monkeypatch):
    calls = []
    kept = audit._removed
    monkeypatch.setattr(audit, "_removed", lambda *a: calls.append(1) or kept(*a))
    names, taken, _ = audit.walk(np.ones((2, 32, 3), np.int64))
    assert len(names) == 120 and taken.shape == (2, 120, 5, 3) and len(calls) == 5 + 119 * 2
