"""Offline curation and comparison queries, each with its SQL equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions import urls
from kerbside.operators import boxes, curation, vectors
from kerbside.plans.track_queries import det
from kerbside.sources import detections as D

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Pictures in which boxes can overlap: rows of ten frames count as one.
BOXES = f"""WITH RECURSIVE {D.DET_SQL}, boxes AS (SELECT channel_id, frame // 10 AS pic, det_ord AS box, (x + 20000) % 200 AS x1, (y + 15000) % 150 AS y1, (x + 20000) % 200 + w AS x2, (y + 15000) % 150 + h AS y2,
    confidence AS score FROM det)"""


def scenes(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    rows = det(spark, sf_dir)
    x, y = (F.col("x") + 20000) % 200, (F.col("y") + 15000) % 150
    return rows.select(
        "channel_id", F.floor(F.col("frame") / 10).alias("pic"), F.col("det_ord").alias("box"), x.alias("x1"), y.alias("y1"),
        (x + F.col("w")).alias("x2"), (y + F.col("h")).alias("y2"), F.col("confidence").alias("score"), *more,
    ).withColumns({c: F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")})


WIDE = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
AREAS = "((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1))"
IOU = f"({WIDE})::DOUBLE / greatest({AREAS} - ({WIDE}), 1e-9)"


@query(
    f"{BOXES}, p AS (SELECT a.channel_id, a.pic, {IOU} AS iou FROM boxes a JOIN boxes b ON a.channel_id = b.channel_id AND a.pic = b.pic AND a.box < b.box)"
    " SELECT channel_id, count(*) AS pairs, count(*) FILTER (iou >= 0.5) AS near, round(max(iou), 6) AS most FROM p GROUP BY ALL"
)
def iou_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = boxes.pair_figures(scenes(spark, sf_dir), "channel_id", ["channel_id", "pic"])
    return found.withColumn("most", F.round("most", 6))


@query(
    f"{BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY channel_id, pic ORDER BY score DESC, box) AS k FROM boxes WHERE score > 0.25),"
    " kept AS (SELECT channel_id, pic, k, [k] AS keep FROM r WHERE k = 1 UNION ALL SELECT s.channel_id, s.pic, b.k, CASE WHEN EXISTS (SELECT 1 FROM r a"
    f" WHERE a.channel_id = s.channel_id AND a.pic = s.pic AND list_contains(s.keep, a.k) AND ({WIDE})::DOUBLE / ({AREAS} - ({WIDE}) + 1e-6) > 0.45)"
    " THEN s.keep ELSE list_append(s.keep, b.k) END FROM kept s JOIN r b ON b.channel_id = s.channel_id AND b.pic = s.pic AND b.k = s.k + 1),"
    " last AS (SELECT channel_id, pic, max_by(keep, k) AS keep FROM kept GROUP BY ALL)"
    " SELECT r.channel_id, r.pic, r.box, round(r.score, 9) AS score FROM r JOIN last l USING (channel_id, pic) WHERE list_contains(l.keep, r.k)"
)
def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.nms(scenes(spark, sf_dir), ["channel_id", "pic"]).select("channel_id", "pic", "box", F.round("score", 9).alias("score"))


def two_models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = scenes(spark, sf_dir)
    moved = own.withColumns({c: F.col(c) + F.col("box") % 9 for c in ("x1", "x2")}).where("box % 5 <> 0")
    return own, moved


MATCHED = (
    f"{BOXES}, other AS (SELECT channel_id, pic, box, x1 + box % 9 AS x1, y1, x2 + box % 9 AS x2, y2 FROM boxes WHERE box % 5 <> 0),"
    f" near AS (SELECT a.channel_id, a.pic, a.box AS box_a, b.box AS box_b, {IOU} AS iou FROM boxes a JOIN other b ON a.channel_id = b.channel_id AND a.pic = b.pic),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY channel_id, pic ORDER BY iou DESC, box_a DESC, box_b DESC) AS k FROM near WHERE iou >= 0.5),"
    " kept AS (SELECT channel_id, pic, k, [k] AS keep, [box_a] AS a, [box_b] AS b FROM r WHERE k = 1 UNION ALL SELECT s.channel_id, s.pic, n.k,"
    " CASE WHEN list_contains(s.a, n.box_a) OR list_contains(s.b, n.box_b) THEN s.keep ELSE list_append(s.keep, n.k) END,"
    " CASE WHEN list_contains(s.a, n.box_a) OR list_contains(s.b, n.box_b) THEN s.a ELSE list_append(s.a, n.box_a) END,"
    " CASE WHEN list_contains(s.a, n.box_a) OR list_contains(s.b, n.box_b) THEN s.b ELSE list_append(s.b, n.box_b) END"
    " FROM kept s JOIN r n ON n.channel_id = s.channel_id AND n.pic = s.pic AND n.k = s.k + 1),"
    " final AS (SELECT channel_id, pic, max_by(keep, k) AS keep FROM kept GROUP BY ALL),"
    " matches AS (SELECT r.channel_id, r.pic, r.box_a, r.box_b, round(r.iou, 9) AS iou FROM r JOIN final USING (channel_id, pic) WHERE list_contains(keep, r.k))"
)


@query(f"{MATCHED} SELECT * FROM matches")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.agreement(*two_models(spark, sf_dir), ["channel_id", "pic"]).withColumn("iou", F.round("iou", 9))


@query(
    f"{MATCHED}, n AS (SELECT channel_id, count(*) AS total FROM boxes GROUP BY ALL), m AS (SELECT channel_id, count(*) AS matched FROM matches GROUP BY ALL)"
    " SELECT channel_id, total, coalesce(matched, 0) AS matched, round(coalesce(matched, 0) / greatest(total, 1), 3) AS rate FROM n LEFT JOIN m USING (channel_id)"
)
def agreement_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = two_models(spark, sf_dir)
    return boxes.agreement_rate(boxes.agreement(left, right, ["channel_id", "pic"]), left, ["channel_id", "pic"])


UNMATCHED = (
    "SELECT channel_id, pic, box, 'a' AS model FROM boxes WHERE (channel_id, pic, box) NOT IN (SELECT channel_id, pic, box_a FROM matches) UNION ALL"
    " SELECT channel_id, pic, box, 'b' FROM other WHERE (channel_id, pic, box) NOT IN (SELECT channel_id, pic, box_b FROM matches)"
)


@query(f"{MATCHED} {UNMATCHED}")
def unmatched_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = two_models(spark, sf_dir)
    keys = ["channel_id", "pic"]
    return boxes.unmatched(boxes.agreement(left, right, keys), left, right, keys)


@query(
    f"{BOXES}, n AS (SELECT box, greatest(0.0, least(1.0, x1 / 150.0)) AS l, greatest(0.0, least(1.0, x2 / 150.0)) AS r, greatest(0.0, least(1.0, y1 / 100.0)) AS t,"
    " greatest(0.0, least(1.0, y2 / 100.0)) AS b FROM boxes) SELECT box, round((l + r) / 2, 6) AS ncx, round((t + b) / 2, 6) AS ncy, round(r - l, 6) AS nw,"
    " round(b - t, 6) AS nh FROM n WHERE r > l AND b > t"
)
def box_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = boxes.to_normalised(scenes(spark, sf_dir), 150, 100)
    return found.select("box", *[F.round(c, 6).alias(c) for c in ("ncx", "ncy", "nw", "nh")])


@query(
    "WITH b(bucket, lo, hi) AS (VALUES (0, 0, 50), (1, 50, 100), (2, 100, 200), (3, 200, 300), (4, 300, 400), (5, 400, 490))"
    " SELECT CAST(bucket AS INT) AS bucket, count(value) AS n FROM b LEFT JOIN events ON value >= lo AND (value < hi OR bucket = 5 AND value <= hi) GROUP BY ALL"
)
def bucket_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.histogram(D.read_events(spark, sf_dir), "value")


@query(
    f"WITH {D.DET_SQL} SELECT channel_id, CAST(greatest(0, least(6, trunc((confidence - 0.3::DOUBLE) / 0.1::DOUBLE))) AS INT) AS bucket, count(*) AS n FROM det GROUP BY ALL"
)
def conf_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = curation.confidence_bucket(F.col("confidence")).alias("bucket")
    return det(spark, sf_dir).groupBy("channel_id", bucket).agg(F.count(F.lit(1)).alias("n"))


PER_FRAME = f"WITH {D.DET_SQL}, f AS (SELECT channel_id, frame, count(*) AS c, max(confidence) AS best FROM det WHERE confidence > 0.5 GROUP BY ALL)"


def per_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = det(spark, sf_dir).where("confidence > 0.5").groupBy("channel_id", "frame")
    return found.agg(F.count(F.lit(1)).alias("c"), F.max("confidence").alias("best"))


@query(
    f"{PER_FRAME} SELECT channel_id, CAST(sum(c) AS BIGINT) AS total, count(*) AS frames, round(avg(c), 2) AS mean, CAST(trunc(median(c)) AS INT) AS median,"
    " CAST(trunc(quantile_cont(c, 0.9)) AS INT) AS p90, max(c) AS most FROM f GROUP BY GROUPING SETS ((channel_id), ())"
)
def frame_stats_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each site and for all of them, in one pass."""
    return per_frame(spark, sf_dir).rollup("channel_id").agg(
        F.sum("c").alias("total"), F.count(F.lit(1)).alias("frames"), F.round(F.avg("c"), 2).alias("mean"), F.median("c").cast("int").alias("median"),
        F.percentile("c", 0.9).cast("int").alias("p90"), F.max("c").alias("most"),
    )


@query(
    f"{PER_FRAME}, a AS (SELECT channel_id, frame, count(*) AS b FROM det GROUP BY ALL) SELECT a.channel_id, count(*) AS before, count(f.c) AS kept,"
    " round(100.0 * (1 - count(f.c) / greatest(count(*), 1)), 2) AS reduction FROM a LEFT JOIN f USING (channel_id, frame) GROUP BY ROLLUP (a.channel_id)"
)
def site_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = det(spark, sf_dir).select("channel_id", "frame").distinct()
    both = every.join(per_frame(spark, sf_dir), ["channel_id", "frame"], "left")
    before, kept = F.count(F.lit(1)), F.count("c")
    return both.rollup("channel_id").agg(
        before.alias("before"), kept.alias("kept"), F.round(100.0 * (1 - kept / F.greatest(before, F.lit(1))), 2).alias("reduction")
    )


ORDERED = "row_number() OVER (PARTITION BY source ORDER BY {}md5('7:' || doc_id), doc_id)"


@query(
    f"WITH r AS (SELECT doc_id, source, {ORDERED.format('')} AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)"
    " SELECT doc_id, source, CASE WHEN k <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM r"
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.split(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", "7")


@query(
    f"WITH r AS (SELECT doc_id, source, {ORDERED.format('')} AS k, count(*) OVER (PARTITION BY source) AS n FROM documents), s AS (SELECT source,"
    " CASE WHEN k <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM r)"
    " SELECT source, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'valid') AS valid, count(*) FILTER (split = 'test') AS test FROM s GROUP BY ALL"
)
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stratified_split(spark, sf_dir).groupBy("source").pivot("split", ["train", "valid", "test"]).count()
    return found.na.fill(0)


@query(f"WITH r AS (SELECT doc_id, source, {ORDERED.format('')} AS k FROM documents) SELECT doc_id, source FROM r WHERE k <= 5")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 5, "7")


@query(
    f"WITH r AS (SELECT doc_id, source, {ORDERED.format('CASE WHEN doc_id % 37 = 0 THEN 0 ELSE 1 END, ')} AS k FROM documents) SELECT doc_id, source FROM r WHERE k <= 5"
)
def forced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return curation.sample(docs, "source", "doc_id", 5, "7", F.col("doc_id") % 37 == 0)


#: A hash of 62 bits: every third is the sign of an embedding's value, the others are of a group of four vectors, so that
#: near ones are few.
SIGNS = """WITH h AS (SELECT label, vec_id, list_sum(list_transform(range(0, 62), lambda k: CASE WHEN k % 3 <> 0 THEN ((vec_id // 40 * 7919 + k * (31 + vec_id // 40)) % 97 > 48)::BIGINT * (1::BIGINT << k)
    ELSE (embedding[k + 1] > 0)::BIGINT * (1::BIGINT << k) END))::BIGINT AS phash FROM embeddings)"""


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    bits = [
        F.when((F.expr("vec_id div 40") * 7919 + k * (31 + F.expr("vec_id div 40"))) % 97 > 48 if k % 3 else F.get("embedding", F.lit(k)) > 0, F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
        for k in range(62)
    ]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return rows.select("label", "vec_id", total.alias("phash"))


@query(f"{SIGNS} SELECT a.label, a.vec_id AS a, b.vec_id AS b FROM h a JOIN h b ON a.label = b.label AND a.vec_id < b.vec_id AND bit_count(xor(a.phash, b.phash)) <= 5")
def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.near_hashes(hashes(spark, sf_dir), "label", "vec_id", "phash")


@query(
    f"{SIGNS.replace('WITH', 'WITH RECURSIVE', 1)}, p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b FROM h a JOIN h b ON a.label = b.label AND a.vec_id <> b.vec_id"
    " AND bit_count(xor(a.phash, b.phash)) <= 5), w AS (SELECT label, a AS node, a AS root FROM p UNION SELECT p.label, p.b, w.root FROM w JOIN p ON p.label = w.label AND p.a = w.node)"
    " SELECT label, node, min(root) AS root FROM w GROUP BY ALL"
)
def dup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.duplicates(hashes(spark, sf_dir), "label", "vec_id", "phash")


@query(
    "WITH a AS (SELECT source AS k, count(*) AS v FROM documents GROUP BY ALL), b AS (SELECT CASE WHEN l.doc_id IS NULL THEN d.lang || '/unlabelled' ELSE d.source END AS k, count(*) AS v"
    " FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL) SELECT k AS site, coalesce(a.v, 0) AS old, coalesce(b.v, 0) AS new, coalesce(b.v, 0) - coalesce(a.v, 0) AS delta,"
    " round((coalesce(b.v, 0) - coalesce(a.v, 0))::DOUBLE / greatest(coalesce(a.v, 0), 1) * 100, 1) AS pct FROM a FULL JOIN b USING (k)"
)
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by source, against labelled ones by source and the others by language."""
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    old = docs.groupBy(F.col("source").alias("site")).agg(F.count(F.lit(1)).alias("v"))
    both = docs.select("doc_id", "source", "lang").join(labels.select("doc_id", F.lit(True).alias("labelled")), "doc_id", "left")
    site = F.when(F.col("labelled").isNull(), F.concat("lang", F.lit("/unlabelled"))).otherwise(F.col("source"))
    return curation.manifest_diff(old, both.groupBy(site.alias("site")).agg(F.count(F.lit(1)).alias("v")), "site", "v")


@query(
    f"{PER_FRAME}, a AS (SELECT channel_id, frame, count(*) AS n FROM det GROUP BY ALL) SELECT a.channel_id, CASE WHEN f.c IS NULL THEN 'empty' WHEN f.best >= 0.8"
    " THEN 'accepted' ELSE 'flagged' END AS bin, count(*) AS frames FROM a LEFT JOIN f USING (channel_id, frame) GROUP BY ALL"
)
def label_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = det(spark, sf_dir).select("channel_id", "frame").distinct()
    both = every.join(per_frame(spark, sf_dir), ["channel_id", "frame"], "left")
    bin_ = curation.route(F.col("best"), F.coalesce("c", F.lit(0)), 0.8)
    return both.groupBy("channel_id", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("frames"))


@query("SELECT d.doc_id FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
def pending_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query(
    "SELECT a.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'accepted' END, CASE WHEN l.quality = 0 THEN 'flagged' END, 'none') AS found FROM documents a LEFT JOIN labels l USING (doc_id)"
)
def label_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    accepted = labels.where("quality = 1").select("doc_id", F.lit("accepted").alias("x"))
    flagged = labels.where("quality = 0").select("doc_id", F.lit("flagged").alias("y"))
    both = docs.select("doc_id").join(accepted, "doc_id", "left").join(flagged, "doc_id", "left")
    return both.select("doc_id", F.coalesce("x", "y", F.lit("none")).alias("found"))


@query(
    "WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0), v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),"
    " p AS (SELECT q.vec_id AS query_id, v.vec_id, greatest(0, 1 - list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e)))) AS d FROM q, v"
    " WHERE q.vec_id <> v.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) AS k FROM p)"
    " SELECT query_id, vec_id, CAST(k AS INT) AS k, round(d, 6) AS distance FROM r WHERE k <= 5"
)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set, every fiftieth vector, against all rows, block by block."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    asked = rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return vectors.nearest(rows, asked, 5).select("query_id", "vec_id", "k", F.round("d", 6).alias("distance"))


@query(
    "SELECT p_partkey, CASE WHEN lower(p_name || ' ' || p_type) LIKE '%car%' OR lower(p_name || ' ' || p_type) LIKE '%sedan%' OR lower(p_name || ' ' || p_type) LIKE '%suv%' THEN 'car'"
    " WHEN lower(p_name || ' ' || p_type) LIKE '%truck%' OR lower(p_name || ' ' || p_type) LIKE '%lorry%' OR lower(p_name || ' ' || p_type) LIKE '%pickup%' THEN 'truck'"
    " WHEN lower(p_name || ' ' || p_type) LIKE '%bus%' OR lower(p_name || ' ' || p_type) LIKE '%coach%' THEN 'bus'"
    " WHEN lower(p_name || ' ' || p_type) LIKE '%bike%' OR lower(p_name || ' ' || p_type) LIKE '%bicycle%' OR lower(p_name || ' ' || p_type) LIKE '%cycle%' THEN 'bike' END AS class FROM part"
)
def keyword_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", "p_name", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", curation.keyword_class(text).alias("class"))


@query(
    "SELECT page_id, CASE WHEN regexp_matches(url, '^https?://(www\\.)?(youtube\\.com/watch|youtu\\.be/|youtube\\.com/live/)') THEN 'video' WHEN regexp_matches(url, '^https?://') THEN 'stream'"
    " ELSE 'file' END AS kind, regexp_extract(url, '([^/?#]+)/?(?:[?#].*)?$', 1) AS leaf FROM pages"
)
def url_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.kind(F.col("url")).alias("kind"), urls.leaf(F.col("url")).alias("leaf"))
