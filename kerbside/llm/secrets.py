"""Secret scan with multipart credential linking, built-in functions only.

Three base kinds are secrets on their own. Weak candidates (short values, login names, endpoints) say little
alone; they are reported only when the parts that complete a credential co-occur in the same scope: no more than
``REACH`` code points lie between the end of one interval and the start of the other. For that interval join, texts are
dealt in tiles of twice that length, and a candidate joins every tile that its interval touches when widened by half of
REACH on either side; so two in reach of each other share a tile, however long they are. A tile holds what fits in its
code points, whatever the length of its document, so that no group grows with the data.

Defined cases: a null text is empty; an empty text has no spans; repeated rows (same doc_id and text) give one
row in ``scan`` and are all kept by ``redact``; equal starts order by kind as listed; documents with a null id are told
apart by their texts; extra columns, whatever their names, are ignored by ``scan`` and kept by ``redact``; time is linear in
the length of a text, but for tiles full of candidates; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.common import whole_rows

#: (kind, pattern, measured group, least length of that group). Fixed values of the contract first.
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Further candidates of the method, weak on their own.
WEAK = [
    ("login", r"""((?i:user(?:name)?|login|account|client_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]+)""", 2, 3),
    ("endpoint", r"(?i:https?|ftp|ssh|wss?|jdbc|postgres|mysql|redis|s3)://[A-Za-z0-9_.:@/?=&%~+-]+", 0, 8),
]
#: In the order in which spans of equal start are listed. short_assign and short_access fail the base lengths.
KINDS = ["assign", "access", "hex", "short_assign", "short_access", "login", "endpoint"]
IDENTIFIERS, SECRETS, STRONG = ("access", "short_access", "login"), ("assign", "hex", "short_assign"), ("assign", "access", "hex")
#: Most code points between linked parts.
REACH = 512
TILE = 2 * REACH
#: Texts are cut out of pieces of so many code points.
PIECE = 4096


def _matches(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (kind, gap before, matched length, measured length) of the leftmost non-overlapping matches."""
    all_ = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.transform(
        F.arrays_zip(F.split(text, pattern).alias("gap"), all_.alias("m"), measured.alias("g")),
        lambda x: F.struct(
            F.lit(kind).alias("kind"),
            F.length(x["gap"]).alias("gap"),
            F.length(x["m"]).alias("len"),
            (F.length(x["g"]) >= least).alias("long"),
        ),
    )
    return F.when(text.rlike(pattern), rows)


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, kind, start, end`` of all base and weak candidates, in code points."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(
        "doc_id",
        F.xxhash64("text").alias("text_key"),
        *[_matches(text, *x).alias(f"_{x[0]}") for x in BASE + WEAK],
    )
    kinds = F.array_compact(F.array(*[f"_{x[0]}" for x in BASE + WEAK]))
    runs = found.select("doc_id", "text_key", F.explode(kinds).alias("run"))
    rows = runs.select("doc_id", "text_key", F.posexplode("run").alias("k", "x")).select("doc_id", "text_key", "k", "x.*")
    # a repeated row has its matches twice
    rows = rows.groupBy("doc_id", "text_key", "kind", "k").agg(*[F.first(c).alias(c) for c in ("gap", "len", "long")])
    # the end of a match is the sum of the gaps and matches up to it; the last gap has no match
    own = Window.partitionBy("doc_id", "text_key", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.coalesce(F.col("len"), F.lit(0))).over(own).cast("int")
    flat = rows.withColumn("end", end).where("len is not null").withColumn("start", F.col("end") - F.col("len"))
    kind = F.when(F.col("long"), F.col("kind")).when(F.col("kind").isin("assign", "access"), F.concat(F.lit("short_"), "kind"))
    return flat.select("doc_id", "text_key", kind.alias("kind"), "start", "end").where("kind is not null")


def link(found: DataFrame) -> DataFrame:
    """All candidates of each document as one array, each with ``reported``: base ones always, weak ones if their
    complements lie within REACH code points."""
    tile = lambda at: F.floor(F.greatest(at, F.lit(0)) / TILE)
    touched = F.sequence(tile(F.col("start") - REACH // 2), tile(F.col("end") + REACH // 2))
    one = F.struct("kind", "start", "end")
    tiled = found.select("doc_id", "text_key", one.alias("c"), F.explode(touched).alias("tile"))
    scopes = tiled.groupBy("doc_id", "text_key", "tile").agg(F.collect_list("c").alias("all"))

    def near(x: Column, roles: tuple[str, ...], strong: bool = False) -> Column:
        """Is a candidate of these roles within reach of x, in the tile?"""
        names = [k for k in roles if not strong or k in STRONG]
        return F.exists(
            "all",
            lambda y: y["kind"].isin(*names)
            & (F.greatest(y["start"] - x["end"], x["start"] - y["end"]) <= REACH)
            & ~((y["start"] < x["end"]) & (x["start"] < y["end"])),
        )

    def completes(x: Column) -> Column:
        end = near(x, ("endpoint",))
        return (
            F.when(x["kind"].isin(*STRONG), True)
            .when(x["kind"] == "endpoint", near(x, IDENTIFIERS) & near(x, SECRETS))
            .when(x["kind"].isin(*IDENTIFIERS), near(x, SECRETS, True) | (near(x, SECRETS) & end))
            .otherwise(near(x, IDENTIFIERS, True) | (near(x, IDENTIFIERS) & end))
        )

    kept = F.filter("all", completes)
    return (
        scopes.groupBy("doc_id", "text_key")
        .agg(F.array_distinct(F.flatten(F.collect_list(kept))).alias("spans"))
    )


def scan(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, text_key, spans``, an array of (kind, start, end) by start, then kind as listed."""
    order = F.create_map(*[F.lit(x) for pair in zip(KINDS, range(len(KINDS))) for x in pair])
    spans = F.transform(
        F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), F.element_at(order, x["kind"]).alias("k"), x["end"].alias("end"), x["kind"].alias("kind")))),
        lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")),
    )
    linked = link(candidates(docs)).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), spans.alias("spans"))
    every = docs.select("doc_id", F.xxhash64("text").alias("text_key")).distinct()
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return every.join(
        linked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left"
    ).select("doc_id", "text_key", F.coalesce("spans", none).alias("spans"))


def _cut(text: Column, parts: Column, mask: str) -> Column:
    """The ``parts`` (a, b) of ``text``, joined by ``mask``. Each is cut out of the pieces that it touches, since to find a
    place in a text Spark counts its characters from the start."""

    def part(pieces: Column, x: Column) -> Column:
        touched = F.sequence(F.floor(x["a"] / PIECE), F.floor((x["b"] - 1) / PIECE))
        cut = lambda k: F.substring(
            F.get(pieces, k.cast("int")),
            (F.greatest(x["a"] - k * PIECE, F.lit(0)) + 1).cast("int"),
            (F.least(x["b"] - k * PIECE, F.lit(PIECE)) - F.greatest(x["a"] - k * PIECE, F.lit(0))).cast("int"),
        )
        return F.when(x["b"] > x["a"], F.array_join(F.transform(touched, cut), "")).otherwise("")

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    # bound to a name, the pieces are made once and not for each part
    return F.get(F.transform(F.array(pieces), lambda held: F.array_join(F.transform(parts, lambda x: part(held, x)), mask)), F.lit(0))


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The documents with every reported span replaced by ``mask``; overlapping spans share one mask, all other
    text and columns stay as they are."""
    spans = scan(docs).where(F.size("spans") > 0).select("doc_id", "text_key", F.posexplode("spans").alias("k", "x"))
    before = Window.partitionBy("doc_id", "text_key").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    start, reach = F.col("x")["start"], F.coalesce(F.max(F.col("x")["end"]).over(before), F.lit(0))
    cuts = spans.select("doc_id", "text_key", "k", start.alias("start"), F.col("x")["end"].alias("end"), reach.alias("reach"))
    # what lies before each span that no earlier one overlaps; the rest of the text comes last
    between = F.when(F.col("start") >= F.col("reach"), F.struct(F.col("reach").alias("a"), F.col("start").alias("b")))
    found = cuts.groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg(
        F.array_sort(F.collect_list(between)).alias("parts"), F.max("end").alias("end")
    )
    rows = whole_rows(docs, own="doc_id", own_key=F.xxhash64("text"))
    joined = rows.join(found, F.col("own").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")), "left")
    text = F.col("row")["text"]
    parts = F.concat("parts", F.array(F.struct(F.col("end").alias("a"), F.length(text).alias("b"))))
    masked = F.when(F.col("parts").isNotNull(), _cut(text, parts, mask)).otherwise(text)
    return joined.select(*[masked.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
