"""One query for each corpus operator, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm import audit, chat, decontaminate, extract, jaccard, jpeg, langid, manifest, merkle, pack, quality, repeats, secrets
from kerbside.llm.common import table
from kerbside.llm.oracles import ORACLES


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _listed(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    names = [x[0] for x in secrets.BASE]
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in names]
    base = F.filter("spans", lambda x: x["kind"].isin(*names))
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed("spans").alias("spans"))


#: A conversation whose texts hold the template's own control strings.
ODD_CONVERSATION = r"\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = [(-7, k, role, ODD_CONVERSATION) for k, role in enumerate(("user", "assistant"))]
    return chat.digest(chat.expand(rows.unionByName(spark.createDataFrame(odd, rows.schema))))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    languages, model = langid.learn(docs.where(~held_out).select("doc_id", "lang", "text"))
    found = langid.identify(docs.select("doc_id", "text"), languages, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


def op6_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replica is the table with damage: some payloads have another first character, some archives lost their tails."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rotten = F.substring(F.md5(F.col("page_id").cast("string")), 1, 2) == "03"
    html = F.when(rotten & (F.length("html") > 0), F.concat(F.lit("#"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    lost = F.coalesce(F.pmod("page_id", F.lit(merkle.ARCHIVE_IDS)) >= merkle.ARCHIVE_IDS - 6, F.lit(False))
    replica = pages.where(~lost).withColumn("html", html)
    return merkle.audit(pages, replica)


def op7_url_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_differenced", "n_marked")


def op8_baseline_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.decode(jpeg.encode(table(spark, sf_dir, "documents")))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(table(spark, sf_dir, "documents"))


def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def op13_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_decontaminate, op3_secrets, op4_language_id, op5_ngram_jaccard, op6_merkle_audit,
        op7_url_differencing, op8_baseline_jpeg, op9_best_fit_packing, op10_suffix_repeats, op11_filter_audit, op12_dataset_manifest, op13_host_quality,
    )
}

__all__ = ["ORACLES", "QUERIES"]
