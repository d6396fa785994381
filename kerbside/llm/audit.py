"""Audit of how filters interact: what each of them removes in every order they can be applied in.

A document's failures are five bits. Documents are counted once by part and bits, 32 cells a part at most; every order is
then read from the cells alone. Orders are visited by single swaps of neighbours (the walk of Steinhaus, Johnson and
Trotter): a swap changes what the two swapped steps remove, and nothing before or after them, so two steps are
counted anew and the three others stay. The Shapley sum of a filter gathers what it removes along the walk.

The filter for copies asks whether a smaller id has the same text, over the whole table: the least id of each text is
joined by text and id together, so that a text that a third of the rows share meets its least id alone.

Defined cases: a null text is empty; a null source is the part of the empty string; a null id has no label, is no copy of anything and
nothing's original; equal ids with one text are no copies of each other; several labels of an id count as their maxima, and
a missing one as 0; other columns are ignored, so clashing names do no harm; an empty table has no part and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import materialize, with_words

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
#: Parts whose orders are made at a time: 600 rows each.
PARTS = 64
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def own_failures(text: Column, words: Column) -> Column:
    """Bits of the filters A to D, the first filter lowest."""
    n = F.size(words).cast("long")
    fails = (
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    )
    return sum((x.cast("int") * (1 << k) for k, x in enumerate(fails)), F.lit(0))


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask, n``: rows of each id by part and the bits of all filters."""
    text = F.coalesce("text", F.lit(""))
    own = with_words(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text")))
    own = own.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), own_failures(F.col("text"), F.col("words")).alias("own"))
    rows = materialize(own.groupBy("doc_id", "part", "digest", "own").agg(F.count(F.lit(1)).alias("n")), "failures")
    first = rows.groupBy(F.col("digest").alias("of")).agg(F.min("doc_id").alias("first"))
    met = rows.join(first, (F.col("digest") == F.col("of")) & (F.col("doc_id") == F.col("first")), "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    mask = F.col("own") + copy.cast("int") * (1 << FILTERS.index("E"))
    return met.groupBy("doc_id", "part", mask.alias("mask")).agg(F.sum("n").alias("n"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, cells``: an array of ``mask, n, good, toxic`` for each part."""
    marks = labels.groupBy(F.col("doc_id").alias("of")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    met = failures(docs).join(marks, F.col("doc_id") == F.col("of"), "left")
    of = lambda c: F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0).cast("long")).alias(c)
    counts = met.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))
    return counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def swaps(n: int) -> Iterator[int]:
    """Places k whose swap with k+1, one after the other, visits all orders of n things once."""
    if n < 2:
        return
    inner, down = swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        k = next(inner, None)
        if k is None:
            return
        # the largest thing stands at one end: before the others, it shifts their places by one
        yield k + 1 if down else k
        down = not down


def _removed(held: np.ndarray, before: int, own: int) -> np.ndarray:
    """By part: rows, good and toxic ones that fail ``own`` and none of the filters in ``before``."""
    masks = np.arange(held.shape[1])
    return held[:, (masks & own > 0) & (masks & before == 0)].sum(axis=1)


def walk(held: np.ndarray, filters: str = FILTERS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All orders, what each step of them removes (part, order, step, count), and the Shapley sums (part, filter).

    ``held``: rows, good and toxic ones (part, mask, 3)."""
    order = list(range(len(filters)))
    steps = [_removed(held, sum(1 << f for f in order[:s]), 1 << order[s]) for s in order]
    names, taken, shapley = [], [], np.zeros((held.shape[0], len(filters)), np.int64)

    def visit() -> None:
        names.append("".join(filters[f] for f in order))
        taken.append(np.stack(steps, axis=1))
        for s, f in enumerate(order):
            shapley[:, f] += steps[s][:, 0]

    visit()
    for k in swaps(len(filters)):
        order[k], order[k + 1] = order[k + 1], order[k]
        before = sum(1 << f for f in order[:k])
        steps[k] = _removed(held, before, 1 << order[k])
        steps[k + 1] = _removed(held, before | 1 << order[k], 1 << order[k + 1])
        visit()
    return names, np.stack(taken, axis=1), shapley


def _report(parts: list[str], held: np.ndarray) -> pa.RecordBatch:
    """The rows of these parts, as SCHEMA has them."""
    names, taken, shapley = walk(held)
    masks = np.arange(held.shape[1])
    failing = np.stack([held[:, masks & 1 << f > 0, 0].sum(axis=1) for f in range(len(FILTERS))], axis=1)
    letters = np.array([[FILTERS.index(x) for x in name] for name in names])
    removed = taken[..., 0]
    shape = removed.shape
    columns = {
        "kept": held[:, :, 0].sum(axis=1)[:, None, None] - removed.cumsum(axis=2), "removed": removed, "redundant": failing[:, letters] - removed,
        "unique_fails": held[:, 1 << letters, 0], "good_lost": taken[..., 1], "toxic_lost": taken[..., 2], "shapley": shapley[:, letters],
    }
    per = shape[1] * shape[2]
    arrays = [
        pa.array(np.repeat(np.arange(len(parts)), per)),
        pa.array(np.tile(np.repeat(np.array(names), shape[2]), shape[0])),
        pa.array(np.tile(np.arange(1, shape[2] + 1, dtype=np.int32), shape[0] * shape[1])),
        *[pa.array(np.ascontiguousarray(columns[c]).reshape(-1).astype(np.int64)) for c in COUNTS],
    ]
    arrays[0] = pa.array(parts, pa.string()).take(arrays[0])
    return pa.RecordBatch.from_arrays(arrays, names=["part", "filter_order", "step", *COUNTS])


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, PARTS):
            rows = batch.slice(start, PARTS).to_pylist()
            held = np.zeros((len(rows), 1 << len(FILTERS), 3), np.int64)
            for k, row in enumerate(rows):
                for c in row["cells"]:
                    held[k, c["mask"]] = c["n"], c["good"], c["toxic"]
            yield _report([row["part"] for row in rows], held)


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step, zeros included: SCHEMA."""
    return cells(docs, labels).mapInArrow(_orders, SCHEMA)
