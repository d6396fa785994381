"""Quality rules of documents and of the hosts they come from, with built-in functions only.

Each document is held against rules of its own. Failures are counted by host, and each host's rate of each rule is shrunk
towards the rate of all documents by a beta prior, whose strength is how much hosts differ beyond chance. A host then has
a verdict on each rule, joined back to its documents: ``base`` failing at more than ``HOST_BASE`` condemns the host's
documents, and a soft rule failing at more than ``HOST_SOFT`` condemns those that fail it; elsewhere a soft failure alone
is no reason to go. A host of few documents has the prior's rate, whatever its few documents do.

Repeated windows are found in one sort of a text's window hashes (64 bits of xxhash of the words' own), so that work
is n log n in a text's words; texts without a repeated hash skip the sort.

Defined cases: a null text has no words; a null source is a host of its own; null ids and repeated rows are judged and
counted row by row; hosts whose rates all agree to chance have the rate of all documents; other columns are ignored, so
clashing names do no harm; an empty table has no rows, and no prior.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import materialize, with_words

WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Soft rules: symbols and repeated lines in a hundred words, and characters of a word.
MOST_SYMBOLS, MOST_LINES, SHORT_WORDS, LONG_WORDS = 10, 5, 3, 12
#: Shrunk rates above which a host is condemned, by base rules or by a soft one.
HOST_BASE, HOST_SOFT = 0.5, 0.25
#: Bounds of the prior's weight in documents.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 10_000.0
#: Documents of one host are dealt to so many tasks where they meet its verdict.
SALTS = 32

SOFT = ("symbols", "lines", "word_length")
RULES = ("base", *SOFT)


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = with_words(docs.select("doc_id", "source", text.alias("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    own = F.transform("words", lambda w: F.xxhash64(w))
    rows = rows.select(
        "doc_id", "source", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("lines"), own.alias("own"),
    )
    places = F.when(F.size("own") >= WINDOW, F.sequence(F.lit(0), F.size("own") - WINDOW)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("windows", F.transform(places, lambda i: F.xxhash64(*[F.get("own", i + k) for k in range(WINDOW)])))
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    found = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("sorted", F.when(again, found))
    same = lambda x, k: F.get("sorted", k)["h"].eqNullSafe(x["h"])
    twice = F.filter("sorted", lambda x, k: ((k > 0) & same(x, k - 1)) | same(x, k + 1))
    rows = rows.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        "at", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n")),
    )
    return rows.select(
        "doc_id", "source", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered["n"], F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def with_failures(found: DataFrame) -> DataFrame:
    """Adds ``fails_*`` for each rule, in whole numbers; soft rules ask only texts with words."""
    words = F.col("n_words")
    has = words > 0
    fails = {
        "base": (words < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * words),
        "symbols": has & (100 * F.col("n_symbols") > MOST_SYMBOLS * words),
        "lines": has & (100 * F.col("n_dup_lines") > MOST_LINES * words),
        "word_length": has & ((F.col("word_chars") < SHORT_WORDS * words) | (F.col("word_chars") > LONG_WORDS * words)),
    }
    return found.withColumns({f"fails_{k}": v for k, v in fails.items()})


def prior(hosts: DataFrame) -> DataFrame:
    """One row: ``mean_*`` and ``weight_*`` of each rule's beta prior over hosts.

    Moments: hosts' rates vary by chance, m(1-m)/n on average, and by m(1-m)/(weight+1) besides."""
    n = F.col("n_docs")
    sums = [F.sum("n_docs").alias("all"), F.count(F.lit(1)).alias("hosts"), F.sum(n * n).alias("squares"), *[F.sum(f"n_{r}").alias(f"k_{r}") for r in RULES],
            *[F.sum(F.col(f"n_{r}") * F.col(f"n_{r}") / n).alias(f"q_{r}") for r in RULES]]
    one = hosts.agg(*sums)
    out = []
    for r in RULES:
        m = F.col(f"k_{r}") / F.col("all")
        # between hosts: sum of n (rate - m)^2, against what chance gives; Kish's size of unequal hosts
        between = F.col(f"q_{r}") - F.col("all") * m * m
        chance = (F.col("hosts") - 1) * m * (1 - m)
        spread = F.try_divide(between - chance, F.col("all") - F.col("squares") / F.col("all"))  # of one host: null
        weight = F.when((F.col("hosts") > 1) & (spread > 0), F.try_divide(m * (1 - m), spread) - 1).otherwise(F.lit(MOST_WEIGHT))
        weight = F.least(F.greatest(weight, F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT))
        out += [m.alias(f"mean_{r}"), F.coalesce(weight, F.lit(MOST_WEIGHT)).alias(f"weight_{r}")]
    return one.select(*out)


def host_rates(found: DataFrame) -> DataFrame:
    """``source, n_docs`` and, for each rule, ``n_*`` failures and the shrunk ``rate_*`` of each host."""
    hosts = found.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.sum(F.col(f"fails_{r}").cast("long")).alias(f"n_{r}") for r in RULES])
    hosts = materialize(hosts, "hosts")
    of = prior(hosts).first()
    rate = lambda r: (F.col(f"n_{r}") + of[f"mean_{r}"] * of[f"weight_{r}"]) / (F.col("n_docs") + of[f"weight_{r}"])
    if of is None or of["mean_base"] is None:
        return hosts.select("source", "n_docs", *[F.col(f"n_{r}") for r in RULES], *[F.lit(0.0).alias(f"rate_{r}") for r in RULES])
    return hosts.select("source", "n_docs", *[F.col(f"n_{r}") for r in RULES], *[rate(r).alias(f"rate_{r}") for r in RULES])


def judge(docs: DataFrame) -> DataFrame:
    """The features of every row with ``base_failed``, ``host_failed`` and ``kept``.

    Verdicts of hosts that condemn nothing are left out of the join; the others are there once a salt, so that the
    documents of one host meet them in many tasks."""
    found = materialize(with_failures(features(docs)), "quality")
    rates = host_rates(found)
    verdict = rates.select(F.col("source").alias("host"), (F.col("rate_base") > HOST_BASE).alias("host_base"), *[(F.col(f"rate_{r}") > HOST_SOFT).alias(f"host_{r}") for r in SOFT])
    bad = verdict.where(reduce(lambda a, b: a | b, [F.col(f"host_{r}") for r in RULES]))
    bad = bad.withColumn("host_salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    met = salted.join(bad, F.col("source").eqNullSafe(F.col("host")) & (F.col("salt") == F.col("host_salt")), "left")
    blamed = reduce(lambda a, b: a | b, [F.col(f"host_{r}") & F.col(f"fails_{r}") for r in SOFT], F.col("host_base"))
    met = met.withColumn("host_failed", F.coalesce(blamed, F.lit(False)))
    return met.select(
        *[c for c in found.columns if not c.startswith("fails_")], F.col("fails_base").alias("base_failed"), "host_failed",
        (~F.col("fails_base") & ~F.col("host_failed")).alias("kept"))
