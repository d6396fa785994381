"""Benchmark decontamination with built-in functions only.

A broadcast hash set of normalised benchmark n-grams is probed with every token window of every training
document; a probe that finds its hash is verified against the words themselves. Hits become word spans, and
a caller removes the documents or the spans.

Defined cases: a null or word-less text has no windows; items without words never match; an item shorter than
the window is one window of its own length; equal rows (same doc_id and text) give one result row; other
columns are ignored, so clashing names do no harm; an empty benchmark or an empty documents table gives
zero hits or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import whole_rows

WINDOW = 10
#: Benchmark windows are broadcast up to this many (about 200 bytes each); beyond, the join shuffles the documents' windows,
#: each with its own words, about WINDOW times the text. Either way gives the same rows.
BROADCAST_WINDOWS = 500_000

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OTHER_CAPITALS = r"[\p{javaUpperCase}\p{javaTitleCase}&&[^A-Z]]"


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone. ``lower`` is much the faster and differs only where other capitals occur."""
    return F.when(text.rlike(_OTHER_CAPITALS), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def with_words(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``words``: the runs of digits, lower-cased letters and non-ASCII characters, in order."""
    df = df.withColumn("_parts", F.split(lower_ascii(F.coalesce(F.col(text), F.lit(""))), SEPARATORS))
    first = F.when(F.get("_parts", F.lit(0)) == "", 1).otherwise(0)
    last = F.when((F.size("_parts") > 1) & (F.get("_parts", F.size("_parts") - 1) == ""), 1).otherwise(0)
    return df.withColumn(
        "words", F.slice("_parts", first + 1, F.greatest(F.size("_parts") - first - last, F.lit(0)))
    ).drop("_parts")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(n, key, words_text, item_id)`` of every window of every item."""
    items = with_words(benchmark.select("item_id", "text")).where(F.size("words") > 0)
    items = items.withColumn("n", F.least(F.size("words"), F.lit(window)))
    at = items.select("item_id", "n", "words", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("n"))).alias("i"))
    held = at.select("item_id", "n", F.slice("words", F.col("i") + 1, F.col("n")).alias("w"))
    # unused places are null, which the hash skips: equal to hashing the first n words
    key = F.xxhash64(*[F.get("w", F.lit(k)) for k in range(window)])
    return held.select("n", key.alias("key"), F.array_join("w", " ").alias("words_text"), "item_id").distinct()


def _probe(docs: DataFrame, windows: DataFrame, n: int, window: int, small: bool) -> DataFrame:
    """Hits of windows of ``n`` words, with one marker row (place -1) for each document."""
    at = docs.select("*", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("words") - n, F.lit(-1)))).alias("i"))
    padding = [F.lit(None).cast("string")] * (window - n)
    at = at.withColumn("at_key", F.xxhash64(*[F.get("words", F.col("i") + k) for k in range(n)], *padding))
    own = windows.where(F.col("n") == n).select("key", "words_text", "item_id")
    held = F.array_join(F.slice("words", F.greatest(F.col("i"), F.lit(0)) + 1, n), " ")
    n_words = F.size("words").cast("long").alias("n_words")
    if not small:  # what is dealt out is the window's own words, not those of its document
        at = at.select("doc_id", "text_key", n_words, "i", "at_key", F.when(F.col("i") >= 0, held).alias("held"))
        held, n_words = F.col("held"), F.col("n_words")
    same = (F.col("at_key") == F.col("key")) & (F.col("i") >= 0) & (held == F.col("words_text"))
    found = at.join(F.broadcast(own) if small else own, same, "left").where("i < 0 or item_id is not null")
    return found.select("doc_id", "text_key", n_words, "i", F.lit(n).alias("n"), "item_id")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: ``doc_id, text_key, n_words, n_hit, items, spans`` (word spans, merged, end exclusive)."""
    windows = benchmark_windows(benchmark, window)
    held = windows.agg(F.count(F.lit(1)), F.collect_set("n")).first()
    own = with_words(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")).drop("text")
    found = None
    for n in sorted({window, *held[1]}, reverse=True):
        part = _probe(own, windows, n, window, held[0] <= BROADCAST_WINDOWS)
        found = part if found is None else found.unionByName(part.where("i >= 0"))
    by = found.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("i") >= 0, F.struct(F.col("i").alias("s"), (F.col("i") + F.col("n")).alias("e"))))).alias("at"),
        F.collect_set(F.col("item_id").cast("string")).alias("items"),
    )
    # a hit covers what no earlier one does; ends rise with starts but for short items inside long ones
    reach = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["e"]).alias("end"),
            (a["n"] + F.greatest(x["e"] - F.greatest(x["s"], a["end"]), F.lit(0))).alias("n"),
        ),
    )
    return by.select("doc_id", "text_key", "n_words", reach["n"].alias("n_hit"), "items", F.col("at").alias("spans"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a hit, with their own columns; null ids and texts stay, and so do repeated rows."""
    bad = hits(docs, benchmark, window).where("n_hit > 0").select("doc_id", "text_key")
    rows = whole_rows(docs, own="doc_id", own_key=F.xxhash64("text"))
    same = F.col("own").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("text_key"))
    return rows.join(bad, same, "left_anti").select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, text_key, text`` of all documents, their words normalised and the hit ones left out."""
    own = with_words(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")).drop("text")
    found = hits(docs, benchmark, window).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "spans"
    )
    gone = F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["s"], x["e"] - 1))))
    kept = F.array_except(F.sequence(F.lit(-1), F.size("words") - 1), gone)
    kept = F.transform(F.filter(kept, lambda i: i >= 0), lambda i: F.get("words", i))
    return own.join(
        found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    ).select("doc_id", "text_key", F.array_join(kept, " ").alias("text"))
