"""Offline curation of frames: routing, histograms, splits, samples, duplicates, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions import geometry as G
from kerbside.operators import graph
from kerbside.storage import materialize

BOUNDS = (0.0, 50.0, 100.0, 200.0, 300.0, 400.0, 490.0)
TRAIN, VALID = 0.7, 0.15
#: Bits of a perceptual hash, and how many may differ between duplicates.
HASH_BITS, NEAR_BITS = 64, 5
#: Words that tell a class; fixed values. The first class that has one in the label gets it.
KEYWORDS = {"car": ("car", "sedan", "suv"), "truck": ("truck", "lorry", "pickup"), "bus": ("bus", "coach"), "bike": ("bike", "bicycle", "cycle")}


def histogram(rows: DataFrame, value: str, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """Counts between bounds, right-open but for the last; values outside go, empty buckets stay."""
    bucket = F.lit(None).cast("int")
    for k in reversed(range(len(bounds) - 1)):
        last = k == len(bounds) - 2
        inside = (F.col(value) >= bounds[k]) & ((F.col(value) <= bounds[k + 1]) if last else (F.col(value) < bounds[k + 1]))
        bucket = F.when(inside, k).otherwise(bucket)
    counted = rows.select(bucket.alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.range(len(bounds) - 1).select(F.col("id").cast("int").alias("bucket"))
    return every.join(F.broadcast(counted), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def confidence_bucket(confidence: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(6), ((confidence - 0.3) / 0.1).cast("int")))


def route(best: Column, n: Column, least: float = 0.5) -> Column:
    return F.when(n == 0, "empty").when(best >= least, "accepted").otherwise("flagged")


def md5_order(seed: str, column: str) -> Column:
    """A shuffle that any engine repeats."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(column).cast("string")))


def ranked(rows: DataFrame, by: str, name: str, order: list[Column]) -> DataFrame:
    """Adds ``rank`` from 1 and ``total`` inside each group of ``by``."""
    own = Window.partitionBy(by)
    return rows.select("*", F.row_number().over(own.orderBy(*order, name)).alias("rank"), F.count(F.lit(1)).over(own).alias("total"))


def split(rows: DataFrame, by: str, name: str, seed: str) -> DataFrame:
    """Adds ``split``: of each group 70 % train, 15 % valid, the rest test; counts are truncated."""
    found = ranked(rows, by, name, [md5_order(seed, name)])
    train, valid = F.floor(F.col("total") * TRAIN), F.floor(F.col("total") * VALID)
    part = F.when(F.col("rank") <= train, "train").when(F.col("rank") <= train + valid, "valid").otherwise("test")
    return found.withColumn("split", part).drop("rank", "total")


def sample(rows: DataFrame, by: str, name: str, n: int, seed: str, forced: Column | None = None) -> DataFrame:
    """``n`` rows of each group, the forced ones first. The limit is the feature."""
    first = [F.when(forced, 0).otherwise(1)] if forced is not None else []
    return ranked(rows, by, name, [*first, md5_order(seed, name)]).where(F.col("rank") <= n).drop("rank", "total")


#: Rows of a band that meet as they are; those of a larger one meet by a second band of the other bits as well.
CROWDED = 1000


def _bands(rest: Column, bits: int, bands: int) -> Column:
    """``k, v`` of each of so many bands of the lowest ``bits`` bits."""
    width = -(-bits // bands)
    return F.array(*[F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(rest, k * width).bitwiseAND((1 << width) - 1).alias("v")) for k in range(bands)])


def near_hashes(rows: DataFrame, by: str, name: str, hash_: str, near: int = NEAR_BITS, crowded: int = CROWDED) -> DataFrame:
    """Pairs of the same group whose hashes differ in ``near`` bits at most. Of ``near`` + 1 bands of the hash one must
    be equal, so that pairs are looked for in bands alone. Of the bits beside an equal band, ``near`` + 1 bands have an equal one again:
    rows of bands with more than ``crowded`` are dealt out once more by these, and no pair is lost."""
    bands = near + 1
    width = -(-HASH_BITS // bands)
    dealt = rows.select(by, name, hash_, F.inline(_bands(F.col(hash_), HASH_BITS, bands)))
    full = dealt.groupBy(F.col(by).alias("_by"), F.col("k").alias("_k"), F.col("v").alias("_v")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowded)
    met = dealt.join(full, F.col(by).eqNullSafe(F.col("_by")) & (F.col("k") == F.col("_k")) & (F.col("v") == F.col("_v")), "left")
    # the bits below the band, and those above it moved down onto them
    low = F.expr(f"`{hash_}` & (shiftleft(1L, k * {width}) - 1)")
    high = F.expr(f"IF((k + 1) * {width} >= {HASH_BITS}, 0L, shiftleft(shiftrightunsigned(`{hash_}`, (k + 1) * {width}), k * {width}))")
    again = F.when(F.col("_n").isNull(), F.array(F.struct(F.lit(-1).alias("k"), F.lit(0).cast("long").alias("v")))).otherwise(_bands(low.bitwiseOR(high), HASH_BITS - width, bands))
    dealt = met.select(by, name, hash_, "k", "v", F.explode(again).alias("second"))
    a, b = (dealt.select([F.col(c).alias(f"{c}_{s}") for c in dealt.columns]) for s in "ab")
    same = (F.col(f"{by}_a") == F.col(f"{by}_b")) & (F.col("k_a") == F.col("k_b")) & (F.col("v_a") == F.col("v_b")) & (F.col("second_a") == F.col("second_b"))
    found = a.join(b, same & (F.col(f"{name}_a") < F.col(f"{name}_b")) & (G.hamming(F.col(f"{hash_}_a"), F.col(f"{hash_}_b")) <= near))
    return found.select(F.col(f"{by}_a").alias(by), F.col(f"{name}_a").alias("a"), F.col(f"{name}_b").alias("b")).distinct()


def duplicate_groups(pairs: DataFrame, by: str) -> DataFrame:
    """``by, node, root``: each node of the pairs with the smallest one that they connect it with, group by group."""
    node = lambda c: F.struct(F.col(by).alias("g"), F.col(c).alias("x"))
    found = graph.components(pairs.select(node("a").alias("a"), node("b").alias("b")), "duplicates")
    return found.select(F.col("node.g").alias(by), F.col("node.x").alias("node"), F.col("component.x").alias("root"))


def duplicates(rows: DataFrame, by: str, name: str, hash_: str, near: int = NEAR_BITS) -> DataFrame:
    """``by, node, root`` of all rows that have a duplicate in their group: equal hashes are told from their smallest row, and only those meet."""
    first = materialize(rows.groupBy(by, hash_).agg(F.min(name).alias("a"), F.count(F.lit(1)).alias("n")), "hashes")
    pairs = near_hashes(first.withColumnRenamed("a", name), by, name, hash_, near)
    copies = first.where("n > 1").select(F.col(by).alias("_by"), F.col(hash_).alias("_hash"), "a")
    same = rows.join(copies, (F.col(by) == F.col("_by")) & (F.col(hash_) == F.col("_hash")) & (F.col(name) != F.col("a")))
    return duplicate_groups(pairs.unionByName(same.select(by, "a", F.col(name).alias("b"))), by)


def manifest_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Old and new figures side by side, what is missing as 0, with the change in percent of the old."""
    a, b = old.select(key, F.col(value).alias("old")), new.select(key, F.col(value).alias("new"))
    both = a.join(b, key, "full").select(key, F.coalesce("old", F.lit(0)).alias("old"), F.coalesce("new", F.lit(0)).alias("new"))
    change = (F.col("new") - F.col("old")) / F.greatest("old", F.lit(1)) * 100
    return both.select("*", (F.col("new") - F.col("old")).alias("delta"), F.round(change, 1).alias("pct"))


def keyword_class(label: Column, words: dict[str, tuple[str, ...]] = KEYWORDS) -> Column:
    text, found = F.lower(F.trim(label)), F.lit(None).cast("string")
    for name, own in reversed(words.items()):
        found = F.when(F.greatest(*[F.contains(text, F.lit(w)) for w in own]), name).otherwise(found)
    return found


def label_line(class_id: Column, cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """Six places, rounded by the exact value of the double: ``format_string`` rounds its shortest decimals, which differ at halves."""
    return F.concat_ws(" ", class_id.cast("string"), *[F.call_function("format_number", v.cast("double"), F.lit("0.000000")) for v in (cx, cy, w, h)])


def parse_label_line(line: Column) -> Column:
    """The five numbers of a line, or null if it has not five parts."""
    parts = F.split(F.trim(line), r"\s+")
    return F.when(F.size(parts) == 5, F.transform(parts, lambda x: x.try_cast("double")))


def peaks(samples: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and peak of each resource, to one place."""
    return samples.groupBy(key).agg(F.round(F.avg(value), 1).alias("mean"), F.round(F.max(value), 1).alias("peak"))


def summed_arrays(rows: DataFrame, array: str, *keys: str) -> DataFrame:
    """Arrays of counts added place by place; of unequal lengths, the longest counts."""
    flat = rows.select(*keys, F.posexplode(array).alias("k", "v")).groupBy(*keys, "k").agg(F.sum("v").alias("v"))
    one = F.sort_array(F.collect_list(F.struct("k", "v")))
    return flat.groupBy(*keys).agg(F.transform(one, lambda x: x["v"]).alias(array))


def smoothed(rows: DataFrame, keys: list[str], order: str, feature: str, alpha: float = 0.9) -> DataFrame:
    """The running appearance of each track: features of unit length, of which the old weighs ``alpha`` against each new
    one, made unit length again. A fold over the sightings of one track."""
    length = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    unit = lambda x: F.transform(F.array(F.struct(x.alias("x"), length(x).alias("n"))), lambda h: F.transform(h["x"], lambda v: v / h["n"]))[0]
    seen = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.col(feature).cast("array<double>").alias("f"))))
    by = rows.groupBy(*keys).agg(seen.alias("seen"))
    first = unit(F.get("seen", F.lit(0))["f"])
    rest = F.slice("seen", 2, F.greatest(F.size("seen") - 1, F.lit(0)))
    mixed = lambda acc, x: unit(F.zip_with(acc, unit(x["f"]), lambda a, b: a * alpha + b * (1 - alpha)))
    return by.select(*keys, F.aggregate(rest, first, mixed).alias(feature))
