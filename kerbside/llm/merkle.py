"""WARC fixity audit with Merkle trees.

Records are laid out in archives of bounded length, in order; a leaf is the digest of a record and of its offset
range. Every inner node is the digest of up to ``FAN`` children and spans their ranges, up to one root a replica.
Two replicas are compared from their roots downwards: the children of a node are joined only if the node differs,
so that an audit of equal replicas reads two digests, and damage is found along its own branches alone.

Ids of more than ``VERSIONS`` versions in either replica leave their archive for parts of it, into which their versions
are dealt by digest, as many as keep them short. A part has slots and offsets of its own: its slots begin at the number
of the part times ``SLOTS``, and the archive's other ids are part 0. So no archive runs out of slots.

Defined cases: null URLs and payloads are empty; a null record id goes by the hash of its URL and payload; equal
ids are ordered by URL, then payload; repeated rows (same id, URL and payload) are one record; extra columns are
ignored; replicas without records have no nodes, and everything in the other one is then reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.common import materialize

FAN = 16
#: Ids of one archive, and the slots it has; versions of an id beyond its own slot use the others.
ARCHIVE_IDS = FAN**3
SLOT_LEVELS = 4
SLOTS = FAN**SLOT_LEVELS
#: Versions of an id that its archive holds; with so many of each id its slots are full.
VERSIONS = SLOTS // ARCHIVE_IDS
#: Versions in a part of an archive on average; a part has SLOTS slots, so that chance doesn't fill it.
PART_RECORDS = FAN**3
#: Null ids are taken from so many numbers by a hash.
HASHED_IDS = 1 << 40


def warc_record(url: Column, payload: Column) -> Column:
    """A response record: header lines, an empty line, the payload and two line breaks."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def records(pages: DataFrame) -> DataFrame:
    """``record_id, url, length, record_digest, archive`` of every record once."""
    record = warc_record(F.col("url"), F.col("html"))
    own = pages.select(
        F.coalesce("page_id", F.pmod(F.xxhash64("url", "html"), F.lit(HASHED_IDS))).alias("record_id"), "url",
        F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("record_digest"),
    ).distinct()
    return own.withColumn("archive", F.shiftright("record_id", 12))


def crowded(sides: list[DataFrame]) -> DataFrame:
    """``hot_id, parts``: ids with more than VERSIONS versions in one of the replicas, and the parts of their archive."""
    counts = [x.groupBy("archive", "record_id").count().where(F.col("count") > VERSIONS) for x in sides]
    both = counts[0].unionByName(counts[1]).groupBy("archive", "record_id").agg(F.max("count").alias("n"))
    parts = both.groupBy(F.col("archive").alias("of")).agg(F.ceil(F.sum("n") / PART_RECORDS).cast("long").alias("parts"))
    return both.join(parts, F.col("archive") == F.col("of")).select(F.col("record_id").alias("hot_id"), "parts")


def place(own: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """``archive, slot, record_id, url, offset, length, digest``: every record in its place."""
    part = F.lit(0).cast("long")
    if hot is not None:
        own = own.join(hot, F.col("record_id") == F.col("hot_id"), "left")
        part = F.coalesce(1 + F.pmod(F.xxhash64("record_id", "record_digest"), F.col("parts")), part)
    own = own.withColumn("part", part)
    order = Window.partitionBy("archive", "part").orderBy("record_id", "url", "record_digest")
    slot = F.row_number().over(order) - 1 + F.col("part") * SLOTS
    own = own.withColumn("slot", slot.cast("int")).withColumn(
        "offset", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    )
    own = own.withColumn("offset", F.coalesce("offset", F.lit(0).cast("long")))
    digest = F.sha2(F.concat_ws(":", "record_digest", "offset", "length"), 256)
    return own.select("archive", "slot", "record_id", "url", "offset", "length", digest.alias("digest"))


def layout(pages: DataFrame) -> DataFrame:
    """The places of records of which no id is crowded."""
    return place(records(pages))


def tree(leaves: DataFrame, archives: int, width: int = 1) -> list[DataFrame]:
    """Levels of nodes ``node, parent, digest, start, end``, leaves first, the root last.

    The parent of a node is its number without the last digit to base FAN. ``archives``: how many there are at most, and ``width``: how many parts each,
    a power of FAN, which gives the height."""
    node = F.col("archive") * (SLOTS * width) + F.col("slot")
    levels = [
        leaves.select(node.alias("node"), "digest", F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"))
    ]
    height, held = SLOT_LEVELS, 1
    while held < archives * width:
        height, held = height + 1, held * FAN
    for _ in range(height):
        up = levels[-1].withColumn("node_", F.shiftright("node", 4))
        inner = up.groupBy(F.col("node_").alias("node")).agg(
            F.sort_array(F.collect_list(F.struct("node", "digest", "start", "end"))).alias("children")
        )
        parts = F.transform("children", lambda c: F.concat_ws(":", c["node"], c["digest"], c["start"], c["end"]))
        inner = inner.select(
            "node", F.sha2(F.array_join(parts, "\n"), 256).alias("digest"),
            F.get("children", F.lit(0))["start"].alias("start"), F.element_at("children", -1)["end"].alias("end"),
        )
        levels.append(materialize(inner, "tree"))
    return levels


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """``record_id, url, archive, slot, offset, length, status`` of all places where the replica differs.

    ``changed``: the same range, another digest. ``moved``: another offset or length. ``missing``, ``extra``: only one
    replica has the place. Rows are of the primary, or of the replica where it alone has the place."""
    held = [materialize(records(x), "records") for x in (primary, replica)]
    hot = materialize(crowded(held), "crowded")
    most = hot.agg(F.max("parts")).first()[0]
    sides = [materialize(place(x, None if most is None else hot), "fixity") for x in held]
    top = max([s.agg(F.max("archive")).first()[0] or 0 for s in sides])
    width = 1
    while width <= (most or 0):
        width *= FAN
    trees = [tree(s, top + 1, width) for s in sides]
    different = None
    for mine, theirs in zip(reversed(trees[0]), reversed(trees[1])):
        a = mine.select(F.col("node").alias("a"), F.col("digest").alias("da"))
        b = theirs.select(F.col("node").alias("b"), F.col("digest").alias("db"))
        if different is not None:
            parents = different.select("node")
            a = a.join(parents, F.shiftright(a["a"], 4) == parents["node"], "left_semi")
            b = b.join(parents, F.shiftright(b["b"], 4) == parents["node"], "left_semi")
        both = a.join(b, a["a"] == b["b"], "full").where(~F.col("da").eqNullSafe(F.col("db")))
        different = materialize(both.select(F.coalesce("a", "b").alias("node")), "branches")
    node = F.col("archive") * (SLOTS * width) + F.col("slot")
    held = [s.join(different, node == F.col("node"), "left_semi") for s in sides]
    a, b = (x.select([F.col(c).alias(f"{c}_{k}") for c in x.columns]) for x, k in zip(held, "ab"))
    both = a.join(b, (a["archive_a"] == b["archive_b"]) & (a["slot_a"] == b["slot_b"]), "full")
    both = both.where(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
    status = (
        F.when(F.col("record_id_b").isNull(), "missing")
        .when(F.col("record_id_a").isNull(), "extra")
        .when((F.col("offset_a") == F.col("offset_b")) & (F.col("length_a") == F.col("length_b")), "changed")
        .otherwise("moved")
    )
    names = ("record_id", "url", "archive", "slot", "offset", "length")
    return both.select(*[F.coalesce(f"{c}_a", f"{c}_b").alias(c) for c in names], status.alias("status"))
