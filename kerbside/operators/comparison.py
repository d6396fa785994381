"""How teachers (detectors that label pictures) compare: figures of each over a plan of frames, and its agreement with a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.operators import boxes

#: Bounds of the histograms: per cent of the picture that a box covers, and width by height. Right-open but for the last.
AREAS = [0, 0.5, 1, 2, 5, 10, 25, 100]
ASPECTS = [0, 0.5, 1.0, 1.5, 2.0, 3.0, 5.0, 100]
FRAME = ["site", "stem"]


def histogram(value: Column, bounds: list[float]) -> list[Column]:
    """Counts of a value by bucket, as aggregates."""
    last = len(bounds) - 2
    return [F.count_if((value >= lo) & ((value < hi) if k < last else (value <= hi))) for k, (lo, hi) in enumerate(zip(bounds, bounds[1:]))]


def frame_counts(plan: DataFrame, predictions: DataFrame) -> DataFrame:
    """``teacher, site, stem, n``: boxes of each planned frame by each teacher, null where it made no prediction."""
    made = predictions.groupBy("teacher", *FRAME).agg(F.count("box").alias("n"))
    teachers = predictions.select("teacher").distinct()  # a handful
    return plan.select(*FRAME).crossJoin(F.broadcast(teachers)).join(made, ["teacher", *FRAME], "left")


def teacher_stats(plan: DataFrame, predictions: DataFrame, width: int, height: int) -> DataFrame:
    """Figures of each teacher with a prediction. ``predictions``: ``teacher, site, stem, box, x1, y1, x2, y2, score``, a null box being a
    frame without any."""
    frames = frame_counts(plan, predictions)
    n = F.col("n")
    totals = frames.groupBy("teacher").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count_if(n > 0).alias("with_boxes"), F.count_if(n == 0).alias("empty"), F.count_if(n.isNull()).alias("missing"),
        F.round(F.avg("n"), 2).alias("mean"), F.median("n").cast("int").alias("median"), F.percentile("n", 0.9).cast("int").alias("p90"), F.max("n").alias("most"),
    )
    sites = frames.where(n.isNotNull()).groupBy("teacher", "site").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("frames"))
    entry = F.format_string("%s:%d/%d=%s", "site", "total", "frames", F.round(F.col("total") / F.col("frames"), 2).cast("string"))
    sites = sites.groupBy("teacher").agg(F.array_join(F.sort_array(F.collect_list(entry)), " ").alias("sites"))
    own = predictions.where("box is not null").join(plan.select(*FRAME), FRAME, "left_semi")
    wide, tall = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    listed = lambda counts: F.concat_ws(",", *counts)
    shapes = own.groupBy("teacher").agg(
        listed(histogram(wide * tall / (width * height) * 100, AREAS)).alias("areas"),
        listed(histogram(F.when(tall > 0, wide / tall), ASPECTS)).alias("aspects"), F.round(F.avg("score"), 3).alias("mean_conf"),
    )
    return totals.join(sites, "teacher", "left").join(shapes, "teacher", "left").na.fill(0.0, ["mean_conf"])


def agreement(predictions: DataFrame, baseline: str) -> DataFrame:
    """Of each teacher but the baseline: boxes matched with it, the rate of the baseline's that are, and what either has alone, over the frames
    that both predicted."""
    base, others = predictions.where(F.col("teacher") == baseline), predictions.where(F.col("teacher") != baseline)
    both = others.select("teacher", *FRAME).distinct().join(base.select(*FRAME).distinct(), FRAME)
    left = others.where("box is not null").join(both, ["teacher", *FRAME], "left_semi")
    right = base.where("box is not null").drop("teacher").join(both, FRAME)
    matches = boxes.agreement(left, right, ["teacher", *FRAME]).groupBy("teacher").agg(F.count(F.lit(1)).alias("matched"))
    sizes = [x.groupBy("teacher").agg(F.count(F.lit(1)).alias(name)) for x, name in ((left, "candidate"), (right, "baseline"))]
    found = both.select("teacher").distinct().join(sizes[0], "teacher", "left").join(sizes[1], "teacher", "left").join(matches, "teacher", "left")
    found = found.na.fill(0, ["matched", "candidate", "baseline"])
    rate = F.round(F.col("matched") / F.greatest("baseline", F.lit(1)), 3)
    return found.select(
        "teacher", "matched", rate.alias("rate"), (F.col("candidate") - F.col("matched")).alias("extra"), (F.col("baseline") - F.col("matched")).alias("missed"), "baseline", "candidate")


def dashboard(plan: DataFrame, predictions: DataFrame, baseline: str, width: int, height: int) -> DataFrame:
    """Figures and agreement side by side, and a ``line`` of fixed width for each teacher."""
    found = teacher_stats(plan, predictions, width, height).join(agreement(predictions, baseline), "teacher", "left")
    return found.withColumn("line", F.format_string("%-20s %8d %10s %10s", "teacher", "total", F.col("mean").cast("string"), F.col("mean_conf").cast("string")))
