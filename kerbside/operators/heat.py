"""Motion heat of a camera's picture, from boxes: how often each cell of a grid was covered by one of two neighbouring
boxes of a track and not by the other, which is what the difference of two pictures shows.

Boxes are not painted cell by cell: each adds to the corners of a difference array, and two running sums, along the rows
of the grid and then along its columns, give the counts. The groups are a row or a column of one channel's grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pixels of a side of a cell, and those of the picture.
CELL, WIDTH, HEIGHT = 10, 1920, 1080
#: What is brighter than this part of all moving cells is as bright as it.
CLIP = 0.99


def _corners(box: list[Column], weight: int) -> list[Column]:
    """The four entries of a box (cells u1..u2, v1..v2, ends in it) in a difference array; an empty one has none."""
    u1, v1, u2, v2 = box
    one = lambda u, v, w: F.struct(u.alias("u"), v.alias("v"), F.when((u1 <= u2) & (v1 <= v2), w).otherwise(0).alias("w"))
    return [one(u1, v1, weight), one(u2 + 1, v1, -weight), one(u1, v2 + 1, -weight), one(u2 + 1, v2 + 1, weight)]


def motion(det: DataFrame, cell: int = CELL, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """``channel_id, u, v, heat`` of every cell in which something moved: over the steps of each track, cells of the box
    before or the box after, but not of both. What lies outside the picture is cut off; a box covers the cells its pixels lie in."""
    columns, lines = -(-width // cell), -(-height // cell)
    clip = lambda c, most: F.least(F.greatest(F.floor(c / cell), F.lit(0)), F.lit(most))
    inside = (F.col("x") + F.col("w") > 0) & (F.col("x") < width) & (F.col("y") + F.col("h") > 0) & (F.col("y") < height) & (F.col("w") > 0) & (F.col("h") > 0)
    # a box outside is an empty one: it ends before it begins
    box = {
        "u1": F.when(inside, clip(F.col("x"), columns - 1)).otherwise(1), "v1": F.when(inside, clip(F.col("y"), lines - 1)).otherwise(1),
        "u2": F.when(inside, clip(F.col("x") + F.col("w") - 1, columns - 1)).otherwise(0), "v2": F.when(inside, clip(F.col("y") + F.col("h") - 1, lines - 1)).otherwise(0),
    }
    order = Window.partitionBy("channel_id", "track_id").orderBy("frame", "det_ord")
    rows = det.select("channel_id", "track_id", "frame", "det_ord", *[c.cast("long").alias(n) for n, c in box.items()])
    steps = rows.select("channel_id", *box, *[F.lag(c).over(order).alias(f"p_{c}") for c in box]).where("p_u1 is not null")
    now, was = [F.col(c) for c in box], [F.col(f"p_{c}") for c in box]
    both = [F.greatest(now[0], was[0]), F.greatest(now[1], was[1]), F.least(now[2], was[2]), F.least(now[3], was[3])]
    entries = F.array(*_corners(now, 1), *_corners(was, 1), *_corners(both, -2))
    change = steps.select("channel_id", F.inline(F.filter(entries, lambda e: e["w"] != 0))).groupBy("channel_id", "u", "v").agg(F.sum("w").alias("w"))
    along = Window.partitionBy("channel_id", "v").orderBy("u").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("channel_id", "u").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return _dense(_dense(change, "u", "v", columns, along), "v", "u", lines, down).where("w > 0").select("channel_id", "u", "v", F.col("w").alias("heat"))


def _dense(cells: DataFrame, axis: str, other: str, n: int, order) -> DataFrame:
    """Running sums of ``w`` along an axis, with a row for each of its n places up to which a value holds.

    Lines without an entry have no value in any place, so only those with one are laid out."""
    summed = cells.select("channel_id", "u", "v", F.sum("w").over(order).alias("w"))
    own = Window.partitionBy("channel_id", other).orderBy(axis)
    until = F.coalesce(F.lead(axis).over(own), F.lit(n)) - 1
    held = summed.withColumn("_until", F.least(until, F.lit(n - 1))).where(f"w <> 0 and {axis} <= _until")
    return held.select("channel_id", other, "w", F.explode(F.sequence(F.col(axis), F.col("_until"))).alias(axis))


def levels(heat: DataFrame, clip: float = CLIP) -> DataFrame:
    """Adds ``level``, 0 to 255: heat as a part of the ``clip`` percentile of its channel's moving cells, which are as many as a picture has at most."""
    top = heat.groupBy(F.col("channel_id").alias("_of")).agg(F.percentile("heat", clip).alias("_top"))
    met = heat.join(top, F.col("channel_id") == F.col("_of"))
    return met.select("channel_id", "u", "v", "heat", F.floor(F.least(F.col("heat"), F.col("_top")) / F.col("_top") * 255).cast("int").alias("level"))
