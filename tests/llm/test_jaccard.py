"""The n-gram Jaccard join, against all pairs."""

import random

import numpy as np

from kerbside.llm import jaccard


def sets(text):
    w = (text or "").encode().lower().split()
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(rows):
    own = [(i, sets(t)) for i, t in rows]
    parent = {i: i for i, _ in own}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(own):
        for j, b in own[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(a), find(i)) for i, a in own}


def corpus():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(3, 160))]
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.randint(1, 7)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy = copy[: rng.randint(len(copy) * 3 // 4, len(copy))]
            rows.append((len(rows) * 3, " ".join(copy).upper() if rng.random() < 0.1 else " ".join(copy)))
    # a chain: each links with the next alone
    line = [word() for _ in range(200)]
    rows += [(1000 + k, " ".join(line[k * 12 : k * 12 + 100])) for k in range(8)]
    rng.shuffle(rows)
    return rows


def test_components_equal_brute_force(make):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(make(rows)).collect()}
    assert got == brute(rows)
    assert len({c for _, c in got.values()}) < len(rows)


def test_odd_rows(make, odd):
    from tests.llm.conftest import ODD

    got = jaccard.link(odd).collect()
    assert len(got) == odd.count()
    want = brute(list(enumerate(ODD)))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert jaccard.link(make([])).count() == 0


def test_one_of_each_component_stays(make):
    text = " ".join(map(str, range(50)))
    docs = make([(3, text), (1, text + " more"), (2, "other words here"), (9, None), (None, text)])
    kept = jaccard.keep_one(docs)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 9, None] and kept.columns == docs.columns


def test_signature_bound_never_rejects_a_link():
    rng = random.Random(3)
    for _ in range(300):
        base = rng.sample(range(1 << 60), rng.randint(1, 400))
        a = np.unique(np.array(base, np.uint64))
        b = np.unique(np.array(base[: rng.randint(1, len(base))] + rng.sample(range(1 << 60), rng.randint(0, 30)), np.uint64))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            assert jaccard.may_link(jaccard.signature(a), jaccard.signature(b), len(a), len(b), 75)


def test_similar_sets_share_a_first_shingle_in_any_order():
    rng = random.Random(11)
    level = np.array([rng.choice([0, 0, 0, 1, 5]) for _ in range(jaccard.SLOTS)], np.uint8)
    near = 0
    for _ in range(2000):
        base = [rng.getrandbits(64) for _ in range(rng.randint(1, 200))]
        a = np.unique(np.array(base, np.uint64))
        kept = base[: rng.randint(len(base) * 3 // 4, len(base))]
        b = np.unique(np.array(kept + [rng.getrandbits(64) for _ in range(rng.randint(0, len(base) // 3))], np.uint64))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            near += 1
            for x in (level, np.zeros(jaccard.SLOTS, np.uint8)):
                first = [jaccard.prefix(y, x)[0] for y in (a, b)]
                assert len(np.intersect1d(*[y[: jaccard.needed(len(z), 75)] for y, z in zip(first, (a, b))]))
                # what a class must meet to stay
                assert all(len(np.intersect1d(*first)) > -(-75 * len(z) // 100) * jaccard.EXTRA // 100 for z in (a, b))
            low, high = sorted((len(a), len(b)))
            assert np.floor(np.log(high) / np.log(1.36)) - np.floor(np.log(low) / np.log(1.36)) <= 1
    assert near > 500


def test_what_many_documents_share_comes_last(make):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    passage = " ".join(word() for _ in range(40))
    rows = [(i, " ".join(word() for _ in range(60)) + " " + passage) for i in range(400)]
    docs = make(rows)
    counts = jaccard.counted(docs)
    assert counts.sum() == sum(len(sets(t)) for _, t in rows)
    level = jaccard.crowding(counts)
    assert all(level[jaccard._counter(jaccard.shingles(passage))] > 0)
    keys = jaccard.sketches(docs).selectExpr("doc_id class", "doc_id component", "sparse = size(keys) sparse", "true core", "explode(keys) shingle")
    assert jaccard.meeting(keys).count() == 0
    assert {r.component_id for r in jaccard.link(docs).collect()} == set(range(400))


def test_crowded_shingles_meet_too(spark):
    rows = [(5, s, True, c, c) for s in (True, False) for c in (1, 2, 2)]
    rows += [(6, False, True, 3, 3), (7, True, True, 4, 9), (7, True, True, 5, 9), (8, False, True, 4, 9), (8, False, True, 5, 9)]
    rows = spark.createDataFrame(rows, "shingle long, sparse boolean, core boolean, class long, component long")
    assert sorted(map(tuple, jaccard.meeting(rows).collect())) == [(5, True, 1, 1)] * 2 + [(5, True, 2, 2)] * 4


def test_pairs_of_many_common_tiles_are_compared(spark):
    rng = random.Random(13)
    sets_ = {}
    base = [rng.getrandbits(64) for _ in range(60)]
    for i in range(120):
        kept = [x for x in base if rng.random() > 0.12]
        sets_[i] = np.unique(np.array(kept + [rng.getrandbits(64) for _ in range(rng.randint(0, 6))], np.uint64))
    zero = np.zeros(jaccard.SLOTS, np.uint8)
    keys = {i: jaccard.prefix(s, zero)[0].tolist()[: jaccard.needed(len(s), 75)] for i, s in sets_.items()}
    tiles = {}
    for i, own in keys.items():
        for t in own:
            tiles.setdefault(t, []).append(i)
    rows = [
        (t, i, i, len(sets_[i]), jaccard.signature(sets_[i]), len(own), [min(keys[i], key=lambda x, k=k: hash((x, k))) for k in range(3)])
        for t, own in tiles.items() for i in own
    ]
    df = spark.createDataFrame(rows, "tile long, class long, component long, n long, bitmap binary, members long, named array<long>")
    got = {tuple(r) for r in jaccard.across(df, 75).collect()}
    want = {
        (i, j) for i in sets_ for j in sets_ if i < j and set(keys[i]) & set(keys[j])
        and jaccard.may_link(jaccard.signature(sets_[i]), jaccard.signature(sets_[j]), len(sets_[i]), len(sets_[j]), 75)
    }
    assert got == want and len(want) > 500


def test_exact_sizes_at_the_threshold(make):
    """96 shingles of 128 shared is 0.75; one less is not."""
    words = [f"w{i}" for i in range(300)]
    a, b, c = " ".join(words[:116]), " ".join(words[16:132]), " ".join(words[17:133])
    assert {r.doc_id: r.component_id for r in jaccard.link(make([(1, a), (2, b)])).collect()} == {1: 1, 2: 1}
    assert {r.doc_id: r.component_id for r in jaccard.link(make([(1, a), (3, c)])).collect()} == {1: 1, 3: 3}


def test_clashing_columns(spark):
    rows = [(1, "a b c d e f", "en", "s", 1, 2, 3, 4), (2, "a b c d e f", "en", "s", 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _first long, own long, id long, row long")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]


def test_rows_of_one_id_with_different_texts(make):
    """Whatever the order of the rows: each text links by itself, and the component's name is the smallest id in it."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    a, b, c = ([word() for _ in range(80)] for _ in range(3))
    near = lambda x, k: " ".join([*x[:k], word(), *x[k + 1 :]])
    one, two, three = " ".join(a), " ".join(b), " ".join(c)
    rows = [(1, one), (1, two), (2, near(b, 79)), (3, near(a, 0)), (5, three), (5, two), (0, near(c, 79)), (9, three), (7, two)]
    want = {(1, one): 1, (1, two): 1, (2, rows[2][1]): 1, (3, rows[3][1]): 1, (5, three): 0, (5, two): 1, (0, rows[6][1]): 0, (9, three): 0, (7, two): 1}
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        for parts in (1, 5):
            docs = make(rows, parts)
            keys = {(r.doc_id, r.k): r.text for r in docs.selectExpr("doc_id", "text", "xxhash64(text) k").collect()}
            got = {(r.doc_id, keys[r.doc_id, r.text_key]): r.component_id for r in jaccard.linked(docs).collect()}
            assert got == want
    kept = sorted((r.doc_id, r.text) for r in jaccard.keep_one(make(rows)).collect())
    assert kept == sorted(k for k in want if k[0] < 2)
