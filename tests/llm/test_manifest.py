"""The dataset manifest against trees built in plain Python."""

import hashlib
import zlib

import pytest

from kerbside.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, proof string, idx int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, text, lang, source, n):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, k):
    for row in tree[:-1]:
        run = row[k // 3 * 3 : k // 3 * 3 + 3]
        yield k % 3, [x for j, x in enumerate(run) if j != k % 3]
        k //= 3


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for j, s in enumerate(sources):
        for k, (_, _, own, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            ways = [*siblings(trees[s], k), *siblings(top, j)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now = leaf(r[0], r[1] and r[1].replace("\n", ""), *r[2:]) if hit else own
            for at, others in ways:
                now = h(*others[:at], now, *others[at:])
            proof = h(*[x for _, others in ways for x in others])
            out.append((r[0], own, trees[s][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(out, key=str)


def check(spark, rows, parts=3):
    docs = spark.createDataFrame([(*r, "clash", "clash", 3) for r in rows], SCHEMA).repartition(parts)
    got = manifest.manifest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("sizes", [(1,), (2,), (3,), (4,), (1, 1), (1, 3, 9, 27), (10, 1, 28, 2, 5)])
def test_trees_equal_plain_python(spark, sizes):
    rows = [(100 * j + 7 * k - 20, f"text {k}\nline" if k % 2 else f"t{k}", "en", f"s{j}", k) for j, n in enumerate(sizes) for k in range(n)]
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "null id\n", "en", "a", 3), (None, "another", "en", "a", 3), (2, "", "", "", 0), (2, "", "", "", 0), (2, "tie\n", "", "", 0),
            (3, "é😀\n", "fr", "Ä", -5), (4, "b\n", "fr", "z", 1), (5, "c:\n", "fr", "-", 1), (6, "x" * 300_000 + "\n", "fr", "=", 1), (-7, "\n", None, "Z", 0)]
    check(spark, rows)
    check(spark, rows, 1)


def test_one_source_holds_most_rows(spark):
    rows = [(k, f"t{k}\n", "en", "hot" if k % 7 else f"s{k % 5}", k) for k in range(500)]
    check(spark, rows, 9)


def test_empty_table(spark):
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_changed_row_fails_alone(spark):
    rows = [(k, f"a\nb{k}", "en", f"s{k % 3}", k) for k in range(40)]
    docs = spark.createDataFrame([(*r, "", "", 0) for r in rows], SCHEMA)
    bad = {r.doc_id for r in manifest.manifest(docs).where("not verified").collect()}
    assert bad == {k for k in range(40) if zlib.crc32(str(k).encode()) % 2 == 0}
