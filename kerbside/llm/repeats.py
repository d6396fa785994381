"""Exact-substring deduplication: every byte inside a string of ``LENGTH`` bytes that also starts elsewhere goes.

The corpus has no single suffix array. Each string of ``LENGTH`` bytes has an anchor, the least hash of its k-byte
pieces, so equal strings have equal anchors, and the strings of one anchor in a text start side by side: their hull
is a stretch of text. Hulls that occur twice are repeats as a whole, which a count finds. What is left are hulls
that share an anchor with other hulls, at the ends of repeats. These are dealt out by anchor, and each task joins
its groups to texts of bounded size, sorts their suffixes, and derives common prefixes from the Burrows-Wheeler
transform by threshold-bounded interval expansion: breadth-first backward extension finds the places where common
prefixes have 0, 1, 2, ... bytes and stops at ``LENGTH``; places not reached by then lie between repeats.

Anchors with very many different hulls (a passage in a large part of the corpus) would make one task's text grow
with the data. Their strings are counted one by one instead, by 128-bit hashes that combine before the shuffle.

Defined cases: a null text is empty; texts shorter than LENGTH keep all bytes; repeated rows repeat each other;
strings may overlap, also within a document, and never cross documents; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import map_arrow, materialize, slices

LENGTH = 400
PIECE = 128
#: Texts are read in parts of so many bytes, which overlap by a string less a byte.
PART = 1 << 22
#: Different hulls of one anchor that a task takes; beyond, their strings are counted one by one.
HULLS = 4096
#: Bytes of text whose suffixes a task sorts at once; one anchor's hulls alone have at most HULLS * (2 * LENGTH) bytes.
BLOCK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 24) - 1)


def _piece_hashes(data: np.ndarray, piece: int) -> np.ndarray:
    """64-bit hashes of all pieces; ``piece`` is a power of two."""
    h, n = (data.astype(np.uint64) + np.uint64(1)) * _P, 1
    h ^= h >> np.uint64(32)
    while n < piece:
        h = (h[:-n] * _P) ^ h[n:]
        h ^= h >> np.uint64(29)
        n *= 2
    return h * _P


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of ``width``."""
    m, n = key, 1
    while 2 * n <= width:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    return np.minimum(m[: len(key) - width + 1], m[width - n : len(key) - n + 1])


def anchors(text: bytes, length: int = LENGTH, piece: int = PIECE) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, hull digest, first start, last start) of the strings of ``text``, in order."""
    step = PART - length + 1
    for base in range(0, max(len(text) - length + 1, 0), step):
        data = np.frombuffer(text, np.uint8)[base : base + PART]
        h = _piece_hashes(data, piece)
        key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        at = (_least(key, length - piece + 1) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:], len(at)) - 1
        for k, a, b in zip(h[at[first]].view(np.int64).tolist(), (first + base).tolist(), (last + base).tolist()):
            yield k, xxhash.xxh3_64_intdigest(text[a : b + length]) - (1 << 63), a, b


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of ``text`` (symbols of 9 bits) in the order of their first ``depth`` symbols at least, by doubling."""
    n, h = len(text), 4
    symbols = text.astype(np.int64)
    key = symbols
    for k in range(1, h):
        key = key << 9 | np.roll(symbols, -k)
    while True:
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        if h >= depth or new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        key = rank << 32 | np.roll(rank, -h)
        h *= 2


def repeated(text: np.ndarray, length: int) -> np.ndarray:
    """Which places of ``text`` start a string of ``length`` symbols that starts elsewhere too?

    Interval expansion: every interval of rotations with a common prefix is extended backwards by the symbols before
    it. An interval is kept only if its right end is the first to reach that place; the length then is the common
    prefix there. What no interval of fewer than ``length`` symbols reaches is inside a repeat."""
    n = len(text)
    order = suffix_order(text, length)
    before = text[order - 1]
    to = np.empty(n, np.int64)
    to[np.argsort(before, kind="stable")] = np.arange(n)
    first = np.sort(text, kind="stable")  # first symbols of the rotations in order
    reached = np.zeros(n + 1, bool)
    reached[0] = reached[n] = True
    start, stop = np.array([0]), np.array([n])
    for _ in range(length):
        size = stop - start
        inside = np.arange(size.sum()) + np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        owner = np.repeat(np.arange(len(size)), size)
        # extended by the same symbol, what an interval holds stays side by side
        moved = to[inside]
        sort = np.argsort(moved)
        moved, owner = moved[sort], owner[sort]
        cut = (moved[1:] != moved[:-1] + 1) | (owner[1:] != owner[:-1]) | (first[moved[1:]] != first[moved[:-1]])
        edge = np.flatnonzero(cut)
        left = moved[np.concatenate([[0], edge + 1])]
        right = moved[np.append(edge, len(moved) - 1)] + 1
        new = ~reached[right]
        if not new.any() and not len(left):
            break
        reached[right[new]] = True
        start, stop = left[new], right[new]
        if not len(start):
            break
    found = np.empty(n, bool)
    found[order] = ~reached[:-1] | ~reached[1:]
    return found


def _spans(flags: np.ndarray, base: int, length: int) -> Iterator[tuple[int, int]]:
    """Covered stretches, from flags of the starts from ``base`` on; neighbours of less than ``length`` are joined."""
    at = np.flatnonzero(flags)
    if len(at):
        edge = np.flatnonzero(np.diff(at) > length)
        for a, b in zip(at[np.concatenate([[0], edge + 1])], at[np.append(edge, len(at) - 1)]):
            yield int(a) + base, int(b) + base + length


_SPAN = ("doc_id", "text_key", "s", "e")
_SPANS = "doc_id long, text_key long, s long, e long"


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], list(_SPAN))


def _expand_block(hulls: list[tuple], length: int) -> list[tuple]:
    """hulls: (doc_id, text_key, first start, alone, bytes). Spans of the hulls that are alone."""
    parts = []
    for h in hulls:
        parts += [np.frombuffer(h[4], np.uint8).astype(np.uint16) + 1, np.zeros(1, np.uint16)]
    text = np.concatenate(parts)
    flags, at, out = repeated(text, length), 0, []
    for doc, key, base, alone, data in hulls:
        if alone:
            out += [(doc, key, s, e) for s, e in _spans(flags[at : at + len(data) - length + 1], base, length)]
        at += len(data) + 1
    return out


def spans(docs: DataFrame, length: int = LENGTH, piece: int = PIECE, hulls: int = HULLS) -> DataFrame:
    """``doc_id, text_key, s, e``: stretches of bytes inside repeated strings; they may overlap."""
    own = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [
            (doc, key, *a)
            for doc, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text")))
            for a in anchors((text or "").encode(), length, piece)
        ]
        columns = list(zip(*rows)) if rows else [[]] * 6
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], ["doc_id", "text_key", "anchor", "hull", "a", "b"]
        )

    schema = "doc_id long, text_key long, anchor long, hull long, a long, b long"
    found = materialize(map_arrow(own, "text", schema, find), "anchors")
    counted = found.groupBy("anchor", "hull").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("d"))
    counted = materialize(counted, "hulls")
    groups = counted.groupBy("anchor").agg(F.count(F.lit(1)).alias("different"), F.sum("n").alias("all"))
    groups = groups.where("all > 1")
    shared = counted.join(groups, "anchor").select(F.col("anchor").alias("k"), F.col("hull").alias("h"), "n", "d", "different")
    mine = materialize(
        found.join(shared, (F.col("anchor") == F.col("k")) & (F.col("hull") == F.col("h"))).drop("k", "h"), "shared"
    )
    whole = mine.where("n > 1").select("doc_id", "text_key", F.col("a").alias("s"), (F.col("b") + length).alias("e"))
    # a hull that occurs more than once goes along once, in a document that has it, for others to be compared with
    fine = mine.where("different > 1 and (n = 1 or doc_id <=> d)").dropDuplicates(["anchor", "hull"])
    wanted = fine.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(
        F.collect_list(F.struct("anchor", "a", "b", (F.col("n") == 1).alias("alone"), (F.col("different") > hulls).alias("many"))).alias("wanted")
    )
    texts = own.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, key, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text", "wanted"))):
            data = (text or "").encode()
            rows += [(w["anchor"], doc, key, w["a"], w["alone"], w["many"], data[w["a"] : w["b"] + length]) for w in wanted]
        columns = list(zip(*rows)) if rows else [[]] * 7
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
        names = ["anchor", "doc_id", "text_key", "a", "alone", "many", "data"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    schema = "anchor long, doc_id long, text_key long, a long, alone boolean, many boolean, data binary"
    # a repeated row brings its hulls twice; they only stand for others to be compared with, so that changes nothing
    texts = texts.select("doc_id", "text_key", "text", "wanted")
    cuts = materialize(map_arrow(texts, "text", schema, cut), "cuts")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for anchor, *hull in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "text_key", "a", "alone", "data"))):
                if anchor != last and size > BLOCK:
                    yield _span_batch(_expand_block(held, length))
                    held, size = [], 0
                held.append(tuple(hull))
                size += len(hull[-1])
                last = anchor
        if held:
            yield _span_batch(_expand_block(held, length))

    few = cuts.where("not many").drop("many").repartition("anchor").sortWithinPartitions("anchor")
    partial = few.mapInArrow(expand, _SPANS)

    def strings(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, key, a, alone, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "a", "alone", "data"))):
            for k in range(len(data) - length + 1):
                d = xxhash.xxh3_128_intdigest(data[k : k + length])
                rows.append(((d & (1 << 64) - 1) - (1 << 63), (d >> 64) - (1 << 63), doc if alone else None, key if alone else None, a + k))
        columns = list(zip(*rows)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["low", "high", "doc_id", "text_key", "at"])

    single = map_arrow(cuts.where("many"), "data", "low long, high long, doc_id long, text_key long, at long", strings)
    often = single.groupBy("low", "high").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counted_one = single.where("text_key is not null").join(often.drop("n"), ["low", "high"], "left_semi")
    counted_one = counted_one.select("doc_id", "text_key", F.col("at").alias("s"), (F.col("at") + length).alias("e"))
    return whole.unionByName(partial).unionByName(counted_one)


def _merged(found: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in found):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def deduplicate(docs: DataFrame, length: int = LENGTH, **how: int) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes) of every document."""
    found = spans(docs, length, **how)
    by = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(
        F.collect_list(F.struct("s", "e")).alias("found")
    )
    own = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    both = own.join(by, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")

    def remove(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "found"))):
            data, gone, kept, at = (text or "").encode(), _merged(found or []), [], 0
            for s, e in gone:
                kept.append(data[at:s])
                at = e
            kept.append(data[at:])
            rows.append((doc, len(data), sum(e - s for s, e in gone), len(gone), b"".join(kept)))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return map_arrow(both.select("doc_id", "text", "found"), "text", schema, remove)
