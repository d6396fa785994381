"""Merkle manifest of a dataset: a digest of every row, a tree for every source, and one root.

Rows of a source are numbered by id. Level by level, the number of a node divided by ``FAN`` names its parent, and the
sorted array of a parent's children is hashed into it, until a source has one node, its subroot; subroots ordered by
source make a tree of their own. The way back goes down the same groups: a level is joined with the proofs of its
parents, so that siblings are appended once a node and not once a leaf and level.

Numbers come from ranges of (source, id, leaf): counted within a range, plus what the source has in the ranges before it.
So a source that holds a third of the rows is numbered by many tasks.

Defined cases: null values count as ``-``; a null source is a source of its own, the first one; null ids come first in
their source and are never tampered with; equal ids are ordered by leaf, and repeated rows are a leaf each; an empty text
is ``0:``; other columns are ignored, so clashing names do no harm; an empty table has no rows, and no root.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.common import materialize

FAN = 3
#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "array<struct<before:string,after:string>>"


def digest_of(values: list[Column]) -> Column:
    """The leaf of these values: each by its UTF-8 length and itself, or ``-``."""
    parts = [x.cast("string") for x in values]
    framed = [F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in parts]
    return F.sha2(F.concat(*framed), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, tree, leaf, altered``: the digest of each row, and of the row as tampered with (null: not at all).

    ``tree`` is the source as a key that is never null and keeps its order."""
    own = {c: F.col(f"`{c}`") for c in FIELDS}
    tree = F.coalesce(F.concat(F.lit("="), own["source"]), F.lit("-"))
    without = F.replace(own["text"], F.lit("\n"), F.lit(""))
    hit = F.crc32(own["doc_id"].cast("string").cast("binary")) % 2 == 0
    altered = F.when(hit, digest_of([*[own[c] for c in FIELDS[:-1]], without]))
    return docs.select(own["doc_id"], tree.alias("tree"), digest_of(list(own.values())).alias("leaf"), altered.alias("altered"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``idx``, from 0 within each ``tree`` by ``order``, and ``n``, the rows of the tree; no task sees a whole tree."""
    ranged = rows.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    held = ranged.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("held"))
    by = Window.partitionBy("tree")
    before = F.coalesce(F.sum("held").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.select(F.col("tree").alias("of"), F.col("part").alias("at"), before.alias("before"), F.sum("held").over(by).alias("n"))
    here = F.row_number().over(Window.partitionBy("part", "tree").orderBy(*order))
    placed = ranged.withColumn("here", here).join(starts, (F.col("part") == F.col("at")) & (F.col("tree") == F.col("of")))
    return placed.select(*rows.columns, (F.col("here") - 1 + F.col("before")).alias("idx"), "n")


def grow(nodes: DataFrame, name: str, most: int) -> list[DataFrame]:
    """Levels ``tree, idx, n, digest, children``, leaves' parents first, until every tree has one node.

    ``nodes``: ``tree, idx, n, digest`` and more columns, which stay in ``children``; ``most``: rows of the largest tree."""
    levels, held = [], nodes.withColumn("children", F.lit(None).cast("string"))
    own = [c for c in nodes.columns if c not in ("tree", "n")]
    while most > 1:
        live = held.where("n > 1").groupBy("tree", F.floor(F.col("idx") / FAN).alias("up"))
        runs = live.agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct(*own))).alias("children"))
        joined = F.array_join(F.transform("children", lambda c: c["digest"]), "")
        up = runs.select("tree", F.col("up").alias("idx"), F.ceil(F.col("n") / FAN).alias("n"), F.sha2(joined, 256).alias("digest"), "children")
        levels.append(held := materialize(up, f"{name}-level"))
        own, most = ["idx", "digest"], -(-most // FAN)
    return levels


def descend(levels: list[DataFrame], tops: DataFrame, keep: list[str]) -> DataFrame:
    """The children of the lowest level, with ``proof``: before and after each ancestor, from below to the top.

    ``tops``: ``tree, height, proof`` and the columns of ``keep``, a row for each tree; ``height``: levels up to its one node."""
    ways = None
    for height in range(len(levels), 0, -1):
        here = tops.where(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("idx"), "proof", *keep)
        ways = here if ways is None else ways.unionByName(here)
        runs = levels[height - 1].select(F.col("tree").alias("t"), F.col("idx").alias("i"), "children")
        met = runs.join(ways, (F.col("t") == F.col("tree")) & (F.col("i") == F.col("idx")))
        names = F.transform("children", lambda c: c["digest"])
        met = met.select("tree", "proof", *keep, names.alias("names"), F.posexplode("children").alias("k", "child"))
        before = F.array_join(F.slice("names", 1, F.col("k")), "")
        after = F.array_join(F.slice("names", F.col("k") + 2, FAN), "")
        step = F.array(F.struct(before.alias("before"), after.alias("after")))
        ways = met.select("tree", F.col("child.idx").alias("idx"), F.concat(step, "proof").alias("proof"), *keep, "child")
        if height > 1:
            ways = ways.drop("child")
    return ways


def prove(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, altered, subroot, root, proof`` of every row."""
    placed = materialize(numbered(leaves(docs), ["doc_id", "leaf"]).withColumnRenamed("leaf", "digest"), "manifest")
    sizes = placed.groupBy("tree").agg(F.max("n").alias("n"))
    most, trees = sizes.agg(F.max("n"), F.count(F.lit(1))).first()
    levels = grow(placed.select("tree", "idx", "n", "digest", "doc_id", "altered"), "tree", most or 0)
    single = placed.where("n = 1").select("tree", "digest", F.lit(0).alias("height"))
    roots = [x.where("n = 1").select("tree", "digest", F.lit(k + 1).alias("height")) for k, x in enumerate(levels)]
    subroots = reduce(DataFrame.unionByName, roots, single).select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest", "height")
    listed = materialize(numbered(subroots, ["source"]), "subroots")
    above = grow(listed.select("tree", "idx", "n", "digest", "source", "height"), "root", trees or 0)
    nothing = F.array().cast(_STEP)
    if above:
        root = above[-1].select("tree", F.lit(len(above)).alias("height"), nothing.alias("proof"), F.col("digest").alias("root"))
        tops = descend(above, root, ["root"]).select(
            F.col("child.source").alias("tree"), F.col("child.height").alias("height"), "proof", "root", F.col("child.digest").alias("subroot"))
    else:
        tops = listed.select(F.col("source").alias("tree"), "height", nothing.alias("proof"), F.col("digest").alias("root"), F.col("digest").alias("subroot"))
    tops = materialize(tops, "tops")
    lone = placed.where("n = 1").join(tops.where("height = 0").withColumnRenamed("tree", "of"), F.col("tree") == F.col("of"))
    lone = lone.select("doc_id", F.col("digest").alias("leaf"), "altered", "subroot", "root", "proof")
    if not levels:
        return lone
    ways = descend(levels, tops, ["root", "subroot"])
    return ways.select("child.doc_id", F.col("child.digest").alias("leaf"), "child.altered", "subroot", "root", "proof").unionByName(lone)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that this leaf and the siblings of a proof give."""
    return F.aggregate(proof, leaf, lambda a, x: F.sha2(F.concat(x["before"], a, x["after"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: the proof of every row against its row as it is now."""
    found = prove(docs)
    siblings = F.array_join(F.transform("proof", lambda x: F.concat(x["before"], x["after"])), "")
    found = found.withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("proof")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
