"""What the corpus operators share: tables, and bounded slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators.graph import components
from kerbside.storage import discard, materialize, shared_folder

__all__ = ["components", "discard", "map_arrow", "materialize", "shared_folder", "slices", "table", "whole_rows", "with_words"]

#: Rows of one slice of an Arrow batch are taken up to this many text bytes, so that memory in a
#: Python worker follows neither the number of rows in a batch nor the length of most texts.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_rows(docs: DataFrame, **named: str | Column) -> DataFrame:
    """Each row as one struct ``row``, beside the columns that are named here: joins then meet no clashing names."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *[(docs[c] if isinstance(c, str) else c).alias(k) for k, c in named.items()])


#: White space between words, as the contracts of the word operators have it.
SPACES = r"[\x20\x09-\x0D]+"


def with_words(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``words``: the runs of anything but white space, in order. ``text`` must not be null."""
    df = df.withColumn("_parts", F.split(text, SPACES))
    first = F.when(F.get("_parts", F.lit(0)) == "", 1).otherwise(0)
    last = F.when((F.size("_parts") > 1) & (F.get("_parts", F.size("_parts") - 1) == ""), 1).otherwise(0)
    return df.withColumn("words", F.slice("_parts", first + 1, F.greatest(F.size("_parts") - first - last, F.lit(0)))).drop("_parts")


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that each holds about SLICE_BYTES of the column ``text``, or one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


def map_arrow(df: DataFrame, text: str, schema: str, f: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """Applies ``f`` to bounded slices of each partition."""
    return df.mapInArrow(lambda batches: (f(x) for x in slices(batches, text)), schema)
