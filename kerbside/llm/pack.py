"""Best-fit packing by minimum bin slack.

Documents become token ids, those that the vocabulary's own file for ``tokenizers`` gives, and a closing id 0; longer ones are cut into full pieces, the first of which may be
shorter. Only the number of pieces of each length, at most as many rows as a sequence has tokens, decides the
packing: for each bin, a bitset subset-sum over the lengths still there finds the fullest feasible combination
around the longest of them, which is then removed, as often as the counts allow; small lengths fill slack at the
end. The plan is a list of slots
(length, ranks, bin, place); pieces are ranked within their length, in salted buckets, and meet their slots by a
range join, so that no task sees all pieces of a length.

The ids come from the vocabulary's rank file and the library that merges about three times as fast; tests hold them
against ``tokenizers``, whose ids they equal around every code point there is.

Defined cases: a null or empty text is the single id 0; rows with a null id and repeated rows are packed once each; texts
of any length are cut; equal pieces may take each other's place; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.common import map_arrow, materialize

CAPACITY = 2048
#: Parts of the capacity under which lengths may count as small; the best of these is taken.
SMALL = (4, 6, 8, 12)
#: Ranks are counted in buckets of about so many pieces.
BUCKET_PIECES = 1000
#: Buckets whose counts are added up in one window; the sums of so many buckets are added up in another.
RUN = 4096
#: Slots are broadcast up to this many (about 100 bytes each); a capacity of 2048 has some thousands.
BROADCAST_SLOTS = 200_000
#: The special tokens of the vocabulary of 50k, which are one id each wherever they stand in a text.
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(4)
def encoder(path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()):
    """The byte-level vocabulary; strings of special tokens that are not in ``special`` are ordinary text to it."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))


def pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    path: str | None = None,
    pattern: str | None = None,
    special: dict[str, int] = SPECIAL,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, salt`` of every document. ``path``: a rank file; ``pattern``: what
    splits text before the merges; by default those of the byte-level vocabulary of 50k. ``special``: strings that
    are one id each wherever they stand."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN
    own = tuple(special.items())

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids_of = encoder(path, pattern, own).encode_to_numpy
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids = ids_of(text or "", allowed_special="all").astype("<u4").tobytes() + b"\0\0\0\0"
            n = len(ids) // 4
            at = [0, *range(n % capacity or capacity, n + 1, capacity)]
            for k, (a, b) in enumerate(zip(at, at[1:])):
                crc = zlib.crc32(ids[4 * a : 4 * b])
                rows.append((doc, k, a, b - a, crc, zlib.crc32(b"%d" % k, crc)))
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        columns = list(zip(*rows)) if rows else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], list("abcdef"))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"
    return map_arrow(docs.select("doc_id", "text"), "text", schema, cut)


def fullest(counts: dict[int, int], free: int) -> dict[int, int]:
    """Lengths and how often, of these counts, that fill ``free`` as far as any can; longer ones first."""
    # one bit for each fill; the state before each item is kept for the way back
    reach, items, mask = 1, [], (1 << free + 1) - 1
    for length in sorted(k for k in counts if k <= free):
        for _ in range(min(counts[length], free // length)):
            grown = (reach | reach << length) & mask
            if grown == reach:
                break
            items.append((length, reach))
            reach = grown
    fill, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(items):
        if fill >= length and before >> (fill - length) & 1:
            chosen[length] = chosen.get(length, 0) + 1
            fill -= length
    return chosen


Slot = tuple[int, int, int, int, int, int]


def plan_with(counts: dict[int, int], capacity: int, small: int) -> tuple[int, list[Slot]]:
    """Bins used, and slots ``(length, first rank, copies in a bin, bins, first bin, place)``.

    Bins are filled around the longest length left. Lengths under ``small`` wait until the others are placed, then
    fill the slack of those bins, the largest first, and bins of their own: used up early, they would leave the
    middle lengths nothing to be completed with."""
    left = [{k: n for k, n in counts.items() if n and (k < small) == s} for s in (False, True)]
    used = dict.fromkeys(counts, 0)
    slots: list[Slot] = []
    bins = 0

    def take(own: dict[int, int], chosen: dict[int, int], most: int, bin0: int, place: int) -> int:
        times = min(most, *(own[k] // n for k, n in chosen.items()))
        for k, n in sorted(chosen.items(), reverse=True):
            slots.append((k, used[k], n, times, bin0, place))
            place += k * n
            used[k] += n * times
            own[k] -= n * times
            if not own[k]:
                del own[k]
        return times

    def fill(own: dict[int, int]) -> list[tuple[int, int, int]]:
        """(slack, first bin, bins) of the bins that these lengths take."""
        nonlocal bins
        out = []
        while own:
            top = max(own)
            rest = {k: n - (k == top) for k, n in own.items() if n > (k == top)}
            chosen = fullest(rest, capacity - top)
            chosen[top] = chosen.get(top, 0) + 1
            times = take(own, chosen, sum(own.values()), bins, 0)
            out.append((capacity - sum(k * n for k, n in chosen.items()), bins, times))
            bins += times
        return out

    open_ = sorted(fill(left[0]))
    while open_ and left[1]:
        slack, bin0, n = open_.pop()
        if chosen := fullest(left[1], slack):
            times = take(left[1], chosen, n, bin0, capacity - slack)
            if times < n:
                open_.append((slack, bin0 + times, n - times))
    fill(left[1])
    return bins, slots


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Slot]:
    """The slots of the fewest bins over some bounds of small lengths."""
    return min((plan_with(counts, capacity, capacity // k) for k in SMALL), key=lambda x: x[0])[1]


def _before(counts: DataFrame) -> DataFrame:
    """How many pieces of its length come before each bucket. Buckets grow with the data: they are added up in runs, and
    the runs by their sums."""
    counts = counts.withColumn("run", F.floor(F.col("bucket") / RUN))
    inside = F.sum("n").over(Window.partitionBy("length", "run").orderBy("bucket")) - F.col("n")
    runs = counts.groupBy(F.col("length").alias("_l"), F.col("run").alias("_r")).agg(F.sum("n").alias("m"))
    runs = runs.withColumn("base", F.sum("m").over(Window.partitionBy("_l").orderBy("_r")) - F.col("m"))
    both = counts.withColumn("inside", inside).join(runs, (F.col("length") == F.col("_l")) & (F.col("run") == F.col("_r")))
    return both.select(F.col("length").alias("_l"), F.col("bucket").alias("_b"), (F.col("base") + F.col("inside")).alias("before"))


def pack(docs: DataFrame, capacity: int = CAPACITY, **tokenizer: str | dict[str, int]) -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, capacity, **tokenizer), "pieces")
    total = cut.count()
    buckets = max(1, -(-total // BUCKET_PIECES))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(buckets)))
    # at most capacity lengths, whatever the data
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    planned = plan(counts, capacity)
    slots = spark.createDataFrame(
        planned, "slot_length long, rank0 long, copies long, times long, bin0 long, place long"
    )
    before = _before(cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("row", F.row_number().over(own) - 1).join(
        before, (F.col("length") == F.col("_l")) & (F.col("bucket") == F.col("_b"))
    )
    ranked = ranked.withColumn("rank", F.col("row") + F.col("before"))
    inside = (
        (F.col("length") == F.col("slot_length"))
        & (F.col("rank") >= F.col("rank0"))
        & (F.col("rank") < F.col("rank0") + F.col("copies") * F.col("times"))
    )
    placed = ranked.join(F.broadcast(slots) if len(planned) <= BROADCAST_SLOTS else slots, inside)
    at = F.col("rank") - F.col("rank0")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("bin0") + F.floor(at / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("place") + F.pmod(at, F.col("copies")) * F.col("length")).alias("offset"),
    )
