"""Round trips through files in the shared folder, each with the SQL of what comes back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators import curation
from kerbside.plans.track_queries import det
from kerbside.sources import detections as D
from kerbside.sources import files
from kerbside.storage import fresh_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


NORMALISED = f"WITH {D.DET_SQL}, b AS (SELECT channel_id, frame // 20 AS pic, det_ord, cx / 1920.0::DOUBLE AS ncx, cy / 1080.0::DOUBLE AS ncy, w / 1920.0::DOUBLE AS nw, confidence FROM det)"


def _normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det(spark, sf_dir).select(
        F.concat(F.lit("site"), "channel_id").alias("site"), F.concat(F.lit("f"), F.expr("frame div 20")).alias("stem"), F.col("det_ord").alias("box"),
        F.lit(2).alias("class_id"), (F.col("cx") / 1920).alias("cx"), (F.col("cy") / 1080).alias("cy"), (F.col("w") / 1920).alias("w"), (F.col("h") / 1080).alias("h"),
        "confidence",
    )


@query(
    f"{NORMALISED} SELECT 'site' || channel_id AS site, count(*) AS boxes, count(DISTINCT pic) AS frames FROM b GROUP BY ALL"
)
def label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of two bins written as label texts, then recounted from both."""
    path = fresh_folder(spark, "labels")
    bin_ = F.when(F.col("confidence") >= 0.5, "accepted").otherwise("flagged")
    files.write_labels(_normalised(spark, sf_dir).withColumn("bin", bin_), path)
    return files.label_counts(*[files.read_written_labels(spark, path, b) for b in ("accepted", "flagged")])


@query(
    f"{NORMALISED} SELECT 'site' || channel_id AS site, 'f' || pic AS stem, CASE WHEN confidence >= 0.5 THEN 'accepted' ELSE 'flagged' END AS bin, count(*) AS boxes,"
    " sum(CAST(printf('%.6f', ncx) AS DECIMAL(18, 6)))::DOUBLE AS cx, sum(CAST(printf('%.6f', nw) AS DECIMAL(18, 6)))::DOUBLE AS w FROM b GROUP BY ALL"
)
def label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What label texts keep of their boxes: six places, added up as decimals, so that no order of adding shows."""
    path = fresh_folder(spark, "labels")
    bin_ = F.when(F.col("confidence") >= 0.5, "accepted").otherwise("flagged")
    files.write_labels(_normalised(spark, sf_dir).withColumn("bin", bin_), path)
    sides = [files.read_written_labels(spark, path, b).withColumn("bin", F.lit(b)) for b in ("accepted", "flagged")]
    total = lambda c: F.sum(F.col(c).cast("decimal(18,6)")).cast("double").alias(c)
    return sides[0].unionByName(sides[1]).groupBy("site", "stem", "bin").agg(F.count(F.lit(1)).alias("boxes"), total("cx"), total("w"))


@query(
    f"{NORMALISED}, plan AS (SELECT DISTINCT channel_id, pic FROM b), made AS (SELECT channel_id, pic, count(*) FILTER (confidence > 0.6) AS n FROM b WHERE pic % 3 <> 0 GROUP BY ALL)"
    " SELECT 'site' || p.channel_id AS site, count(*) AS frames, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (n = 0) AS empty, CAST(coalesce(sum(n), 0) AS BIGINT) AS boxes"
    " FROM plan p LEFT JOIN made m ON m.channel_id = p.channel_id AND m.pic = p.pic GROUP BY ALL"
)
def prediction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions written as JSON by teacher and site, read again and held against the plan of frames."""
    path = fresh_folder(spark, "predictions")
    own = _normalised(spark, sf_dir)
    pic = F.substring("stem", 2, 9).cast("long")
    confident = F.col("confidence") > 0.6
    made = own.where(pic % 3 != 0).select(
        F.lit("t").alias("teacher"), "site", "stem", *[F.when(confident, F.col(c)).alias(c) for c in ("box", "cx", "cy", "w", "h", "confidence", "class_id")]
    )
    files.write_predictions(made, path)
    found = files.with_predictions(own.select("site", "stem").distinct(), files.read_predictions(spark, path).where("teacher = 't'"))
    return found.groupBy("site").agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") == 0).alias("empty"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("boxes"),
    )


@query(
    "WITH " + D.ARMS_SQL + " SELECT 's' || s_suppkey AS site_id, CAST(CASE WHEN s_suppkey % 7 = 0 THEN 2 ELSE 4 END AS INT) AS corners, arm_id, CAST(arm_ord AS INT) AS arm_ord, x1::DOUBLE + s_nationkey AS x1,"
    " y2::DOUBLE AS y2, junction_side FROM arms, supplier WHERE s_suppkey % 7 <> 0"
)
def site_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each supplier's site written, listed, and read again: the regions of sound ones and their arms in order."""
    folder = fresh_folder(spark, "sites")
    own = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("s"), "s_suppkey").alias("site_id"), "s_suppkey", "s_nationkey")
    corners = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in D.ROI])
    own = own.withColumn("roi", F.when(F.col("s_suppkey") % 7 == 0, F.slice(corners, 1, 2)).otherwise(corners))
    shift = F.col("s_nationkey").cast("double")
    line = lambda arm, x1, y1, x2, y2, side: F.struct(
        F.lit(arm.title()).alias("label"), F.array(x1 + shift, F.lit(float(y1))).alias("start"), F.array(x2 + shift, F.lit(float(y2))).alias("end"), F.lit(side).alias("junction_side"))
    lines = F.create_map(*[x for a in D.ARMS for x in (F.lit(a[0]), line(*a))])
    files.write_sites(own.select("site_id", "roi", lines.alias("lines")), folder)
    listed, sites, arms = (f(spark, folder, files.WRITTEN) for f in (files.list_sites, files.read_sites, files.read_arms))
    bad = files.invalid_sites(sites, arms).select("site_id").distinct()
    sound = sites.join(listed, "site_id").join(bad, "site_id", "left_anti").select("site_id", F.size("roi").alias("corners"))
    return arms.join(sound, "site_id").select("site_id", "corners", "arm_id", "arm_ord", "x1", "y2", "junction_side")


@query("SELECT event_type AS site, count(*) AS v, TRUE AS stamped FROM events GROUP BY ALL")
def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of figures, written with its time and read again."""
    path = fresh_folder(spark, "manifest")
    files.write_manifest(D.read_events(spark, sf_dir).groupBy(F.col("event_type").alias("site")).agg(F.count(F.lit(1)).alias("v")), path)
    return spark.read.schema("generated_at timestamp, site string, v long").json(path).select("site", "v", F.col("generated_at").isNotNull().alias("stamped"))


@query(
    "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)"
    " SELECT CASE WHEN k <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'valid' ELSE 'test' END AS split, source AS site, count(*) AS frames"
    " FROM r GROUP BY ALL"
)
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split written in folders by split and site, and counted there."""
    path = fresh_folder(spark, "split")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    files.write_split(curation.split(docs, "source", "doc_id", "7").withColumnRenamed("source", "site"), path)
    return spark.read.parquet(path).groupBy("split", "site").agg(F.count(F.lit(1)).alias("frames"))


@query("SELECT CAST(row_number() OVER (ORDER BY n_name) - 1 AS INT) AS class_id, n_name AS class_name FROM nation")
def class_name_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class list of one name a line, with blank lines between."""
    path = fresh_folder(spark, "names")
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").agg(F.array_join(F.sort_array(F.collect_list("n_name")), "\n\n").alias("value"))
    names.write.text(path)
    return files.read_class_names(spark, f"{path}/*.txt")


@query("SELECT page_id // 25 AS part, md5(string_agg(coalesce(html, '') || chr(10), '' ORDER BY page_id)) AS digest FROM pages GROUP BY ALL")
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of files by their bytes, as caches key them: all pages, 25 in a file, in order."""
    path = fresh_folder(spark, "files")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.expr("page_id div 25").alias("part"), "page_id", F.coalesce("html", F.lit("")).alias("value"))
    pages.repartition("part").sortWithinPartitions("part", "page_id").drop("page_id").write.partitionBy("part").text(path)
    return files.digests(spark, path).select(F.regexp_extract("path", r"part=(\d+)", 1).cast("long").alias("part"), "digest")
