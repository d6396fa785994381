"""How good a detector is: average precision by class and threshold, and precision and recall where F1 is best.

Predictions are matched picture by picture; the curve of a class then runs over all its predictions by falling score, as
running sums over ranges of it, so that a class that holds most boxes is no single task. The area is that under the
precision envelope at 101 recall levels, with straight lines between the points of the curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.operators import boxes
from kerbside.operators.ranges import running
from kerbside.storage import materialize

#: Overlaps from which a prediction counts as right: 0.50 to 0.95 by 0.05.
THRESHOLDS = [0.5 + 0.05 * k for k in range(10)]
#: Recall levels less one; steps of the confidence grid; half the width of the smoothing of F1 over it.
LEVELS, GRID, SMOOTH = 100, 999, 50


def hits(predictions: DataFrame, truth: DataFrame, keys: list[str], run: str | None = None) -> DataFrame:
    """Predictions with ``tp_0`` to ``tp_9``: 1 where they count as right at that threshold.

    ``run``: the column of several runs that do not compete. Each prediction asks for the true box of its picture and class that it overlaps most (then the least number); a true
    box takes the highest score that asks for it (then the least number)."""
    own, corners = [*keys, "class_name"], ["x1", "y1", "x2", "y2"]
    asked = boxes.nearest(predictions, truth.select(*own, "box", *corners), own)
    asked = asked.withColumn("_to", F.coalesce(sum((F.col("iou") >= t).cast("int") for t in THRESHOLDS), F.lit(0)))
    # a box counts from the threshold that no better one which asks for the same true box reaches, to the last that it reaches itself
    better = Window.partitionBy(*own, *([run] if run else []), "box_b").orderBy(F.desc("score"), "box").rowsBetween(Window.unboundedPreceding, -1)
    asked = asked.withColumn("_from", F.coalesce(F.max("_to").over(better), F.lit(0)))
    right = [((F.col("_from") <= k) & (F.col("_to") > k)).cast("int").alias(f"tp_{k}") for k in range(len(THRESHOLDS))]
    return materialize(asked.select(*predictions.columns, *right), "hits")


def counts(found: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """``n_truth`` and ``n_pred`` of each class that has a true box."""
    there = truth.groupBy("class_name").agg(F.count(F.lit(1)).alias("n_truth"))
    if len(by) > 1:
        there = there.crossJoin(F.broadcast(found.select(*[c for c in by if c != "class_name"]).distinct()))  # runs under comparison: a handful
    seen = found.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pred"))
    return there.join(seen, by, "left").na.fill(0, ["n_pred"])


def curve(found: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """``k, tp, rank``: for each group and threshold, where in the order of scores its recall rises, and to what count."""
    n = len(THRESHOLDS)
    order = [F.desc("score"), *keys, "box"]
    narrow = found.select(*by, *keys, "score", "box", *[f"tp_{k}" for k in range(n)])
    ranked = running(narrow, by, order, {"rank": F.lit(1), **{f"sum_{k}": F.col(f"tp_{k}") for k in range(n)}})
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"tp_{k}").alias("hit"), F.col(f"sum_{k}").alias("tp")) for k in range(n)])
    return ranked.select(*by, "rank", F.explode(F.filter(steps, lambda x: x["hit"] == 1)).alias("s")).select(*by, "s.k", "s.tp", "rank")


def average_precision(found: DataFrame, truth: DataFrame, keys: list[str], run: str | None = None) -> DataFrame:
    """``n_truth, n_pred, ap50, ap50_95`` of each class that has a true box, and of each ``run``."""
    by = ["class_name", *([run] if run else [])]
    sizes = materialize(counts(found, truth, by), "classes")
    own = [*by, "k"]
    levels = lambda until: F.explode(F.sequence(F.lit(0), F.lit(until)))
    # only what lies on either side of a level counts there: of the points up to it the last, of those beyond it the first and the highest
    points = curve(found, by, keys).join(sizes.select(*by, "n_truth"), by)
    level = F.ceil(LEVELS * F.col("tp") / F.col("n_truth")).cast("int").alias("level")
    held = points.groupBy(*own, level).agg(F.max("tp").alias("most"), F.min("rank").alias("first"), F.max(F.col("tp") / F.col("rank")).alias("p"))
    every = sizes.where("n_pred > 0").select("*", levels(len(THRESHOLDS) - 1).alias("k")).select("*", levels(LEVELS).alias("level"))
    up = Window.partitionBy(*own).orderBy("level")
    beyond = up.rowsBetween(1, Window.unboundedFollowing)
    lines = every.join(held, [*own, "level"], "left").select(
        *own, "level", "n_truth", "n_pred", F.coalesce(F.max("most").over(up.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("tp"),
        F.min("first").over(beyond).alias("next_rank"), F.max("p").over(beyond).alias("next"),
    )
    # the last point of a recall, before the next rise, and the envelope there
    last = F.when(F.col("tp") > 0, F.col("tp") / F.coalesce(F.col("next_rank") - 1, F.col("n_pred")))
    last = F.coalesce(last, F.when(F.col("next_rank") == 1, F.lit(1.0)), F.lit(0.0))
    low, ahead = F.greatest(last, F.coalesce("next", F.lit(0.0))), F.coalesce("next", F.lit(0.0))
    lines = lines.withColumns({"low": low, "ahead": ahead})
    here, end = F.col("tp") / F.col("n_truth"), F.when(F.col("next_rank").isNull(), 1.0).otherwise((F.col("tp") + 1) / F.col("n_truth"))
    share = F.when(F.col("level") == LEVELS, F.lit(1.0)).otherwise(F.try_divide(F.col("level") / LEVELS - here, end - here))
    height = F.when(F.col("level") == LEVELS, F.lit(0.0)).otherwise(F.col("low") + (F.col("ahead") - F.col("low")) * share)
    weight = F.when(F.col("level").isin(0, LEVELS), 0.5 / LEVELS).otherwise(1 / LEVELS)
    areas = lines.groupBy(*own).agg(F.sum(height * weight).alias("ap"))
    areas = areas.groupBy(*by).agg(F.sum(F.when(F.col("k") == 0, F.col("ap"))).alias("ap50"), (F.sum("ap") / len(THRESHOLDS)).alias("ap50_95"))
    return sizes.join(areas, by, "left").na.fill(0.0, ["ap50", "ap50_95"])


def operating_point(found: DataFrame, truth: DataFrame, run: str) -> DataFrame:
    """``confidence, precision, recall`` of each ``run`` where the smoothed mean F1 of its classes is best, at 0.5 overlap.

    Scores are counted on a grid, which bounds every window."""
    by = [run, "class_name"]
    sizes = counts(found, truth, by)
    step = F.floor(F.col("score") * GRID).cast("int")
    held = found.groupBy(*by, step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum("tp_0").alias("tp"))
    grid = sizes.select(*by, "n_truth", F.explode(F.sequence(F.lit(0), F.lit(GRID))).alias("step"))
    down = Window.partitionBy(*by).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    met = grid.join(held, [*by, "step"], "left").na.fill(0, ["n", "tp"])
    met = met.select(*by, "step", "n_truth", F.sum("n").over(down).alias("n"), F.sum("tp").over(down).alias("tp"))
    p, r = F.when(F.col("n") == 0, 1.0).otherwise(F.try_divide(F.col("tp"), F.col("n"))), F.col("tp") / F.col("n_truth")
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    mean = met.withColumns({"p": p, "r": r}).groupBy(run, "step").agg(F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg(f1).alias("f1"))
    own = Window.partitionBy(run)
    around = own.orderBy("step").rowsBetween(-SMOOTH, SMOOTH)
    first, last = (F.min_by("f1", "step").over(own), F.max_by("f1", "step").over(own))
    beyond = F.greatest(SMOOTH - F.col("step"), F.lit(0)) * first + F.greatest(F.col("step") + SMOOTH - GRID, F.lit(0)) * last
    smooth = F.round((F.sum("f1").over(around) + beyond) / (2 * SMOOTH + 1), 9)
    best = F.max_by(F.struct("step", "precision", "recall"), F.struct("smooth", (-F.col("step")).alias("s")))
    return mean.withColumn("smooth", smooth).groupBy(run).agg(best.alias("b")).select(run, (F.col("b.step") / GRID).alias("confidence"), "b.precision", "b.recall")


def report(found: DataFrame, truth: DataFrame, keys: list[str], run: str, first: str) -> DataFrame:
    """Each run's mAP at 0.5 and over all thresholds, precision, recall and fitness, and how they differ from those of the run ``first``."""
    areas = average_precision(found, truth, keys, run).groupBy(run).agg(F.avg("ap50").alias("map50"), F.avg("ap50_95").alias("map50_95"))
    each = areas.join(operating_point(found, truth, run).drop("confidence"), run)
    names = ("map50", "map50_95", "precision", "recall", "fitness")
    each = each.withColumn("fitness", 0.1 * F.col("map50") + 0.9 * F.col("map50_95")).select(run, *[F.round(c, 4).alias(c) for c in names])
    base = each.where(F.col(run) == first).select(*[F.col(c).alias(f"_{c}") for c in names])
    both = each.crossJoin(F.broadcast(base))  # one row
    return both.select(run, *names, *[F.round(F.col(c) - F.col(f"_{c}"), 4).alias(f"delta_{c}") for c in names])
