"""Language ID: held-out accuracy, mixtures and odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from kerbside.llm import langid

PARTS = {
    "de": "und ein der sch keit ung ver lich".split(),
    "es": "que los ción para ado con una".split(),
    "en": "the and ing tion with er th".split(),
}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def learned(spark, make):
    rng = random.Random(1)
    rows = [(i, lang, text(rng, lang, 40)) for i in range(120) for lang in [list(PARTS)[i % 3]]]
    schema = "doc_id long, lang string, text string"
    docs = spark.createDataFrame([*rows, (None, "xx", "null id"), (500, None, "null lang"), (501, "en", None)], schema)
    return langid.learn(docs)


def test_held_out_accuracy(make, learned):
    rng = random.Random(2)
    rows = [(i, text(rng, list(PARTS)[i % 3], 15)) for i in range(90)]
    got = {r.doc_id: r for r in langid.identify(make(rows), *learned).collect()}
    assert sum(got[i].lang_pred == list(PARTS)[i % 3] for i in range(90)) >= 88
    assert all(0 <= r.score <= 1 for r in got.values())


def test_mixture_proportions(learned):
    rng = random.Random(4)
    names, table = learned
    mixed = " ".join([text(rng, "de", 60), text(rng, "es", 30)])
    h, bounds, _ = langid.grams([mixed])
    pi = dict(zip(names, langid.mixture(h[slice(*bounds[0])], table)))
    assert pi["de"] > pi["es"] > 0.15 and pi["en"] == 0 and np.isclose(sum(pi.values()), 1)


def test_odd_rows(spark, make, odd, learned):
    rows = langid.identify(odd, *learned).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert [by[i].lang_pred for i in (0, 1, 2, 3)] == ["und"] * 4 and by[4].lang_pred != "und"
    assert langid.identify(make([]), *learned).count() == 0
    nothing = langid.learn(make([]))
    assert {r.lang_pred for r in langid.identify(odd, *nothing).collect()} == {"und"}


def test_grams_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["one two", None, "", "Ünï 9 x", "a"]
    h, bounds, some = langid.grams(texts)
    for t, (a, b), s in zip(texts, bounds, some):
        own, (own_bounds,), (own_some,) = langid.grams([t])
        assert (h[a:b] == own[slice(*own_bounds)]).all() and s == own_some


def plain_mixture(counts, shares, penalty):
    """The same by dictionaries: {trigram: n}, {language: {trigram: share}}."""

    def em(names, start):
        pi = dict(start)
        for _ in range(langid.ROUNDS):
            new = dict.fromkeys(names, 0.0)
            for g, n in counts.items():
                whole = sum(pi[k] * shares[k][g] for k in names)
                for k in names:
                    new[k] += n * pi[k] * shares[k][g] / whole
            pi = {k: v / sum(counts.values()) for k, v in new.items()}
        return pi, sum(n * math.log(sum(pi[k] * shares[k][g] for k in names)) for g, n in counts.items())

    every = list(shares)
    alone = {k: sum(n * math.log(shares[k][g]) for g, n in counts.items()) for k in every}
    top = max(every, key=lambda k: alone[k])
    full, _ = em(every, dict.fromkeys(every, 1 / len(every)))
    chosen, best, out = [top], alone[top], {top: 1.0}
    for k in sorted((k for k in every if k != top), key=lambda k: -full[k]):
        wider = [*chosen, k]
        start = {x: max(full[x], 1e-3) for x in wider}
        pi, likely = em(wider, {x: v / sum(start.values()) for x, v in start.items()})
        if likely - best <= penalty * math.log(sum(counts.values()) + 1):
            break
        chosen, best, out = wider, likely, pi
    return out


def test_predictions_agree_with_plain_expectation_maximisation(make, learned):
    rng = random.Random(9)
    names, table = learned
    rows = [(i, " ".join(text(rng, rng.choice(list(PARTS)), rng.randint(1, 25)) for _ in range(rng.randint(1, 3)))) for i in range(40)]
    got = {r.doc_id: r for r in langid.identify(make(rows), *learned).collect()}
    for i, t in rows:
        h, bounds, _ = langid.grams([t])
        counts = Counter(h[slice(*bounds[0])].tolist())
        want = plain_mixture(counts, {k: np.exp(table[:, j]) for j, k in enumerate(names)}, langid.PENALTY)
        top = max(sorted(want), key=lambda k: want[k])
        assert got[i].lang_pred == top and abs(got[i].score - want[top]) < 1e-6
