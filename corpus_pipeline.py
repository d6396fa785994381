"""The corpus pipeline: from raw documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; it is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm import decontaminate, jaccard, langid, pack, secrets
from kerbside.llm.common import discard, materialize, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null texts and texts without a letter. Labels become the predictions.

    Null ids, null labels and repeated rows stay; of equally likely languages the first by name is taken; where no row is
    labelled, nothing can be learned and all rows go; other columns stay as they are; an empty table stays empty."""
    languages, model = langid.learn(docs.select("doc_id", "lang", "text"))
    return langid.with_language(docs, languages, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents, the one of the smallest id stays.

    Rows with a null id stay, and so do texts without words, which link with nothing; rows that repeat the smallest id
    stay with it; similarity at the threshold links; an empty table stays empty."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go.

    Null ids and null or empty texts stay; repeated rows share their fate; items without words match nothing; an
    empty benchmark removes nothing; an empty table stays empty."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and linked parts of credentials are masked, and ``n_chars`` follows; the documents stay.

    Null ids and texts and repeated rows stay, a null text with its n_chars; spans that overlap share a mask; an empty
    table stays empty."""
    out = secrets.redact(docs)
    size = F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", size)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token pieces in sequences.

    A null or empty text is the closing id alone; rows with a null id and repeated rows are packed once each; pieces of
    equal length may take each other's place; other columns are left out; an empty table has no pieces."""
    return pack.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Tokenization and language ID are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
