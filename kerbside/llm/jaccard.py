"""N-gram Jaccard join: which documents share enough of their word shingles.

Equal shingle sets are one class. Classes meet in size-banded tiles. A tile is a shingle and a band of set sizes; it
holds the classes of that band, and of the band below, that have the shingle among their rarest ones. Within a tile,
hashed bitmap signatures bound the overlap of two sets from above by bit counts, and only pairs that the bound admits
have their sorted shingle arrays intersected, exactly.

No link is lost. Let all shingles have one order. Two sets of a similarity of ``percent`` share so many shingles that
the first ``n - ceil(n * percent / 100) + 1`` of each, n being its size, have one in common; and their sizes differ by a
factor of 100 / percent at most, so they are in one band or in adjacent ones. Any order will do. The one used puts
shingles last that very many documents have, by counts of all shingles in a table of fixed size; so a passage in a large
part of the corpus makes no tile of all those documents.

Links are found in two rounds. The first only takes the tiles of the FEW shingles of each class that have the least
hashes, of which similar sets share most, and compares every class of a tile with the one of the tile that shares most tiles with others; that joins most groups of copies with
as many comparisons as they have members. The second takes all tiles, with ``EXTRA`` percent more shingles of each class
than are needed. Of two linked sets, the one whose shingles end first in the order shares all but so many of them with
the other that 1 + EXTRA percent of its size lie in both lists; so a class that meets others in fewer tiles than that,
counted for the smallest size that may link with it, has no further links and goes, and with it the tiles that only
it kept open. This count, made twice, leaves out what shares a passage but is not similar. Tiles whose classes are by now
in one component need no comparison; in the others, all pairs from different components are compared by signatures,
in blocks of bounded size, and only the pairs that may link are listed. Of tiles with the same classes one is taken, and
of a pair's tiles one that both classes name, if there is one. So pairs inside a linked group are not listed,
and every pair that can be a link is compared or already connected.

Defined cases: a document without words has an empty set and is its own component; with fewer words than a shingle,
the whole sequence is its only one; null texts have no words; repeated rows give one row each; rows of one id with
different texts are documents of their own, which may be in different components, and ``keep_one`` judges each by itself; documents with a
null id join their class but are not its smallest id, and ``keep_one`` keeps them; extra columns, whatever their names,
are ignored by ``link`` and kept by ``keep_one``; ties of size or weight change no component; a text of any length
is one set in memory; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.common import components, discard, map_arrow, materialize, slices, whole_rows
from kerbside.operators.ranges import running

SHINGLE = 5
PERCENT = 75
#: Counters of shingles: SLOTS of them, in chunks.
SLOTS, CHUNK = 1 << 17, 1 << 12
#: Shingles of a class whose tiles the first round takes; percent of a set that the second takes beyond what is needed.
FEW, EXTRA = 8, 8
#: Tiles of a class that are named with it, so that a pair that shares one of them is compared there alone.
NAMED = 4
#: Bits of a signature to a shingle, at least; powers of two from LEAST_BITS on, so that signatures fold onto shorter ones.
LEAST_BITS = 128
REMEMBERED = 150_000
#: Classes of a block of a tile; a task holds two blocks.
BLOCK = 2048


class _Words(dict):
    """Hash of each word; starts anew when it holds many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``text``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _counter(sets: np.ndarray) -> np.ndarray:
    return (sets >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def needed(n: int, percent: int) -> int:
    """So many first shingles of a set of ``n`` meet those of any similar set."""
    return n + (-n * percent // 100) + 1 if n else 0


def prefix(sets: np.ndarray, level: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """The shingles of a sorted set that come first in the order, EXTRA percent more than are needed; and how many of
    them, from the first on, are not crowded."""
    n = len(sets)
    first = needed(n, percent) + n * EXTRA // 100
    crowd = level[_counter(sets)]
    if not crowd.any():
        return sets[:first].view(np.int64), first
    order = np.argsort(crowd, kind="stable")[:first]
    return sets[order].view(np.int64), int(np.searchsorted(crowd[order], 0, "right"))


def crowding(counts: np.ndarray) -> np.ndarray:
    """For each counter, 0 if it is as full as chance would have it, else more by its excess (each doubling counts one)."""
    mean = max(1.0, float(counts.mean()))
    excess = (counts - mean) / (4 * np.sqrt(mean))
    return np.where(excess < 1, 0, 1 + np.floor(np.log2(np.maximum(excess, 1)))).astype(np.uint8)


def commonness(counts: np.ndarray) -> np.ndarray:
    """For each counter, how far it is fuller than chance would have it, from 0 to 1."""
    mean = max(1.0, float(counts.mean()))
    return np.clip((counts - mean) / (4 * np.sqrt(mean)), 0, 1).astype(np.float32)


def counted(docs: DataFrame) -> np.ndarray:
    """How often the shingles of each counter occur in all documents: SLOTS numbers, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SLOTS, np.int64)
        for batch in slices(batches, "text"):
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            held += np.bincount(_counter(np.concatenate(sets)), minlength=SLOTS)
        parts = held.astype(np.int32 if held.max() < 1 << 31 else np.int64).reshape(-1, CHUNK)
        yield _chunks(range(len(parts)), parts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                held.setdefault(chunk, np.zeros(CHUNK, np.int64))
                held[chunk] += np.frombuffer(data, np.int32 if len(data) == 4 * CHUNK else np.int64)
        yield _chunks(held, held.values())

    schema = "chunk int, counts binary"
    each = docs.select("text").mapInArrow(count, schema)
    out = np.zeros((SLOTS // CHUNK, CHUNK), np.int64)
    for r in each.repartition(SLOTS // CHUNK, "chunk").mapInArrow(add, schema).collect():
        out[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
    return out.ravel()


def _chunks(names, parts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(names), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["chunk", "counts"])


def bits_for(size: int) -> int:
    return max(LEAST_BITS, 1 << (2 * size - 1).bit_length())


def signature(sets: np.ndarray) -> bytes:
    """A bit for each hash value modulo the length, set if an odd number of shingles has it."""
    bits = bits_for(len(sets))
    return np.packbits(np.bincount((sets & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def may_link(a: bytes, b: bytes, size_a: int, size_b: int, percent: int) -> bool:
    """Could sets of these sizes and signatures be similar enough? Bits that differ come from shingles that only one has."""
    if 100 * min(size_a, size_b) < percent * max(size_a, size_b):
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    apart = int(np.bitwise_count(x ^ y).sum())
    both = (size_a + size_b - apart) // 2  # the overlap is no more than this
    return 100 * both >= percent * (size_a + size_b - both)


def sketches(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, text_key, n, low, high, keys, sparse, least, bitmap``: size and digest of each document's set, its first shingles, of
    which ``sparse`` are not crowded, the FEW of least hash, how common its shingles are, and its signature."""
    counts = counted(docs)
    level, common = (docs.sparkSession.sparkContext.broadcast(f(counts)) for f in (crowding, commonness))

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, low, high, keys, sparse, least, weights, bitmaps = [], [], [], [], [], [], [], []
        for text in batch.column("text").to_pylist():
            s = shingles(text)
            digest = xxhash.xxh3_128_intdigest(s.tobytes())
            n.append(len(s))
            low.append((digest & (1 << 64) - 1) - (1 << 63))
            high.append((digest >> 64) - (1 << 63))
            first, few = prefix(s, level.value, percent)
            keys.append(first)
            sparse.append(few)
            least.append(s[:FEW].view(np.int64))
            weights.append(float(common.value[_counter(s)].mean()) if len(s) else 0.0)
            bitmaps.append(signature(s) if len(s) else b"")
        lists = []
        for x in (keys, least):
            flat = np.concatenate(x) if x else np.zeros(0, np.int64)
            lists.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(flat)))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()),
                lists[0], pa.array(sparse, pa.int32()), lists[1], pa.array(weights, pa.float64()), pa.array(bitmaps, pa.binary()),
            ],
            ["doc_id", "text_key", "n", "low", "high", "keys", "sparse", "least", "weight", "bitmap"],
        )

    schema = "doc_id long, text_key long, n long, low long, high long, keys array<long>, sparse int, least array<long>, weight double, bitmap binary"
    return map_arrow(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), "text", schema, sketch)


def numbered(some: DataFrame) -> DataFrame:
    """``low, high, least, key, class``: a number for every set that a document with an id has, in the order of their smallest
    ids, with that id and the key of a text of it. Two sets of one id have two numbers."""
    sets = some.where("doc_id is not null").groupBy("low", "high").agg(F.min("doc_id").alias("least"), F.min_by("text_key", "doc_id").alias("key"))
    return materialize(running(sets, [], ["least", "low", "high"], {"class": F.lit(1).cast("long")}), "classes")


def banded(rows: DataFrame, percent: int) -> DataFrame:
    """The rows ``shingle, n, ...`` dealt to size-banded tiles, as ``tile``.

    Bands are a little wider than the factor by which linked sizes may differ, so that rounding loses no pair."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(102.0 / percent)))
    dealt = rows.select("*", F.explode(F.array(band, band + 1)).alias("band"))
    return dealt.withColumn("tile", F.xxhash64("shingle", "band")).drop("band")


def opened(rows: DataFrame, percent: int) -> DataFrame:
    """The rows ``shingle, class, component, n, ...`` dealt to tiles that hold more than one component, with the ``members``
    of each tile."""
    dealt = banded(rows, percent)
    ends = dealt.groupBy("tile").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members"))
    return dealt.join(ends.where("lo <> hi").select("tile", "members"), "tile")


def counted_out(rows: DataFrame, percent: int) -> DataFrame:
    """The rows of classes that meet other components often enough to link with one."""
    least = F.ceil(F.col("n") * percent / 100)
    met = opened(rows, percent).groupBy("class").agg(F.countDistinct("shingle").alias("k"), F.first("n").alias("n"))
    may = met.where(F.col("k") > F.floor(least * EXTRA / 100)).select("class")
    return rows.join(may, "class", "left_semi")


def meeting(rows: DataFrame) -> DataFrame:
    """The ``shingle, core, class, component`` rows, of those with ``sparse``, of shingles in more than one component.

    Shingles that are not crowded have their rows sorted side by side, once. Crowded ones may have any number of
    rows: these combine before the shuffle, and the join splits what is large."""
    ends = [F.min("component").alias("lo"), F.max("component").alias("hi")]
    own = Window.partitionBy("shingle")
    few = rows.where("sparse").select("shingle", "core", "class", "component", *[f.over(own).alias(k) for f, k in zip((F.min("component"), F.max("component")), ("lo", "hi"))])
    crowded = rows.where("not sparse").drop("sparse").select("shingle", "core", "class", "component")
    open_ = crowded.groupBy("shingle").agg(*ends).where("lo <> hi").select("shingle")
    return few.where("lo <> hi").drop("lo", "hi").unionByName(crowded.join(open_, "shingle", "left_semi"))


def _sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = [shingles(t) for t in batch.column("text").to_pylist()]
    return pa.RecordBatch.from_arrays(
        [batch.column("class"), pa.array([s.tobytes() for s in sets], pa.binary())], ["class", "members"]
    )


def _fold(bitmap: bytes, size: int) -> bytes:
    x = np.frombuffer(bitmap, np.uint64)
    while len(x) * 8 > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes()


def _compare(
    tile: int, classes: list[int], parts: list[int], n: list[int], bitmaps: list[bytes], blocks: list[int], named: list[list[int]], percent: int
) -> list[tuple[int, int]]:
    """Pairs of a tile's classes that may link, across components, and across blocks if there are two. A pair with
    a common named tile is left to the first of these."""
    order = sorted(range(len(classes)), key=lambda i: n[i])
    two, out = len(set(blocks)) > 1, []
    for bits in sorted({len(x) for x in bitmaps}):
        # sizes of one band have signatures of this length or twice it
        own = [i for i in order if len(bitmaps[i]) in (bits, 2 * bits)]
        x = np.frombuffer(b"".join(_fold(bitmaps[i], bits) for i in own), np.uint64).reshape(len(own), -1)
        size, part, block = (np.array([v[i] for i in own]) for v in (n, parts, blocks))
        names = np.array([named[i] for i in own]).T
        for k, i in enumerate(own):
            if len(bitmaps[i]) != bits:
                break
            end = int(np.searchsorted(size, 100 * size[k] // percent, "right"))
            if end <= k + 1:
                continue
            here = np.ones(end - k - 1, bool)
            for name in names[::-1]:
                here = np.where(name[k + 1 : end] == name[k], name[k] == tile, here)
            here &= part[k + 1 : end] != part[k]
            if two:
                here &= block[k + 1 : end] != block[k]
            at = np.flatnonzero(here) + k + 1
            apart = np.bitwise_count(x[k] ^ x[at]).sum(1, dtype=np.int64)
            both = (size[k] + size[at] - apart) // 2
            for j in at[100 * both >= percent * (size[k] + size[at] - both)]:
                y = classes[own[j]]
                out.append((min(classes[i], y), max(classes[i], y)))
    return out


def across(tiles: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: pairs of ``tile, class, component, n, bitmap, members, named`` rows that may link, once each."""
    count = F.ceil(F.col("members") / BLOCK).cast("int")
    block = F.pmod(F.hash("class"), count)
    other = F.explode(F.sequence(F.lit(0), count - 1))
    dealt = tiles.withColumn("block", block).select("*", other.alias("other"))
    dealt = dealt.select(
        "tile", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "class", "component", "n", "bitmap", "block", "named"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(6)]
        key, out = None, []

        def flush() -> None:
            nonlocal out
            if len(set(held[1])) > 1:
                out += _compare(key[0], *held, percent)
            for x in held:
                x.clear()

        def batch() -> pa.RecordBatch:
            pairs = sorted(set(out))
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for b in batches:
            for tile, low, high, *row in zip(*(c.to_pylist() for c in b.columns)):
                if (tile, low, high) != key:
                    flush()
                    key = tile, low, high
                    if len(out) > 100_000:
                        yield batch()
                        out = []
                for x, v in zip(held, row):
                    x.append(v)
        flush()
        yield batch()

    own = dealt.repartition("tile", "low", "high").sortWithinPartitions("tile", "low", "high")
    return own.mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: tuple[DataFrame, DataFrame], percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of classes whose sets are similar enough. ``texts``: the documents, and each class's id and text key."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for x in batches for s in slices(iter([x]), "xs")):
            keep = []
            for x, y in zip(batch.column("xs").to_pylist(), batch.column("ys").to_pylist()):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # the sets of those that are left are made again from their texts, rather than kept for all; a repeated row gives its links again
    needed = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    docs, number = texts
    asked = number.join(needed, "class")
    own = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    own = own.join(asked, (F.col("doc_id") == F.col("least")) & (F.col("text_key") == F.col("key"))).select("class", "text")
    members = materialize(map_arrow(own, "text", "class long, members binary", _sets), "sets")
    both = pairs.join(members.select(F.col("class").alias("a"), F.col("members").alias("xs")), "a")
    both = both.join(members.select(F.col("class").alias("b"), F.col("members").alias("ys")), "b")
    links = materialize(both.select("a", "b", "xs", "ys").mapInArrow(exact, "a long, b long"), "links")
    discard(members, shuffles=True)
    return links


def bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and signatures admit."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, x, y = (c.to_pylist() for c in batch.columns)
            keep = [may_link(*r, percent) for r in zip(x, y, na, nb)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda k: classes.select(F.col("class").alias(k), F.col("n").alias(f"n{k}"), F.col("bitmap").alias(f"bits_{k}"))
    signed = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "bits_a", "bits_b")
    return materialize(signed.mapInArrow(bound, "a long, b long"), "pairs")


def linked(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """What ``link`` returns, with the ``text_key`` of each row."""
    held = materialize(sketches(docs, percent), "sketches")
    rows = materialize(held.select("doc_id", "text_key", "n", "low", "high"), "rows")
    some = held.where("n > 0").withColumnRenamed("least", "least_hashes")
    number = numbered(some)
    first = number.select(F.col("low").alias("l"), F.col("high").alias("h"), "least", "key", "class")
    same = (F.col("low") == F.col("l")) & (F.col("high") == F.col("h")) & (F.col("doc_id") == F.col("least")) & (F.col("text_key") == F.col("key"))
    # by the keys of the join, so that nothing is dealt out again
    own = some.join(first, same).dropDuplicates(["low", "high", "doc_id", "text_key"])
    own = materialize(own.select("class", "n", "keys", "sparse", F.col("least_hashes").alias("least"), "weight", "bitmap"), "sets")
    discard(held, shuffles=True)
    classes, keys = own.select("class", "n", "bitmap"), own.select("class", "n", "sparse", "keys")
    texts = (docs, number.select("class", "least", "key"))

    met = banded(own.select("class", "n", "weight", F.explode("least").alias("shingle")), percent).drop("n", "shingle")
    centre = met.groupBy("tile").agg(F.max_by("class", F.struct("weight", -F.col("class"))).alias("centre"), F.count(F.lit(1)).alias("members"))
    centre = centre.where("members > 1").select("tile", "centre")
    stars = met.join(centre, "tile").where("class <> centre")
    stars = stars.select(F.least("centre", "class").alias("a"), F.greatest("centre", "class").alias("b")).distinct()
    near = bounded(stars, classes, percent)
    links = verified(near, texts, percent)
    discard(near)
    joined = components(links, "round1")

    now = keys.join(joined.withColumnRenamed("node", "class"), "class", "left")
    now = now.withColumn("component", F.coalesce("component", "class"))
    now = now.select("class", "component", "sparse", F.col("n") + F.floor(-F.col("n") * percent / 100) + 1, F.posexplode("keys").alias("k", "shingle"))
    now = now.toDF("class", "component", "sparse", "needed", "k", "shingle")
    now = meeting(now.select("shingle", (F.col("k") < F.col("sparse")).alias("sparse"), (F.col("k") < F.col("needed")).alias("core"), "class", "component"))
    # each of these is a large part of the corpus, and is gone when the next one is written
    met = materialize(now.join(keys.select("class", "n"), "class"), "met")
    once = materialize(counted_out(met, percent), "counted1")
    discard(met, shuffles=True)
    twice = materialize(counted_out(once, percent), "counted2")
    discard(once, shuffles=True)
    open_ = now = materialize(opened(twice.where("core"), percent), "open")
    discard(twice, shuffles=True)
    same = now.groupBy("tile").agg(F.count(F.lit(1)).alias("k"), *[F.bit_xor(F.xxhash64("class", F.lit(k))).alias(f"x{k}") for k in (1, 2)])
    now = now.join(same.groupBy("k", "x1", "x2").agg(F.min("tile").alias("tile")).select("tile"), "tile", "left_semi")
    # the same few tiles for classes that share most of theirs
    names = [F.min_by("tile", F.xxhash64("tile", F.lit(k))) for k in range(NAMED)]
    named = now.groupBy("class").agg(F.array(*names).alias("named"))
    now = now.join(named, "class").join(classes.drop("n"), "class")
    pairs = materialize(across(now, percent), "pairs")
    discard(open_, own, shuffles=True)
    more = verified(pairs, texts, percent)
    discard(pairs)
    whole = components(links.unionByName(more), "round2")
    name = number.select(F.col("class").alias("component"), F.col("least").alias("component_id"))
    by_set = number.select("low", "high", "class").join(whole.withColumnRenamed("node", "class"), "class", "left")
    by_set = by_set.withColumn("component", F.coalesce("component", "class")).join(name, "component")
    by_set = by_set.select(F.col("low").alias("l"), F.col("high").alias("h"), "component_id")
    return rows.join(by_set, (F.col("low") == F.col("l")) & (F.col("high") == F.col("h")) & (F.col("n") > 0), "left").select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def link(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document; links are by ``percent`` of the union at least."""
    return linked(docs, percent).drop("text_key")


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that are the smallest of their component, with their own columns."""
    first = linked(docs, percent).where("component_id = doc_id or doc_id is null").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct()
    rows = whole_rows(docs, own="doc_id", own_key=F.xxhash64(docs["text"]))
    return rows.join(first, F.col("own").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")), "left_semi").select("row.*")
