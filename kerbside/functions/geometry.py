"""Geometry and box arithmetic as columns; everything stays inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, places: int) -> Column:
    """To so many places by the scaled value, as databases round numbers: 0.5065 * 1000 falls short of 506.5 and goes down. Spark's
    own ``round`` goes by the shortest text of the number, in which that is a tie and goes up."""
    scale = float(10**places)
    return F.round(value * scale) / scale


def point_in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Even-odd rule with half-open edges; an empty polygon holds nothing. A literal polygon unrolls into one
    predicate behind a test of its bounding box."""
    if len(polygon) < 3:
        return F.lit(False)
    inside = F.lit(False)
    for (xi, yi), (xj, yj) in zip(polygon, [polygon[-1], *polygon[:-1]]):
        if yi == yj:
            continue
        spans = (F.lit(float(yi)) > y) != (F.lit(float(yj)) > y)
        left = x < (xj - xi) * (y - yi) / (yj - yi) + xi
        inside = inside != (spans & left)
    xs, ys = zip(*polygon)
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & inside


def point_in_polygon_array(x: Column, y: Column, polygon: Column) -> Column:
    """The same for a polygon in a column of points (x, y); a null polygon holds everything."""
    before = F.concat(F.slice(polygon, -1, 1), F.slice(polygon, 1, F.size(polygon) - 1))
    edges = F.arrays_zip(polygon.alias("p"), before.alias("q"))
    hit = lambda e: ((e["p"]["y"] > y) != (e["q"]["y"] > y)) & (
        x < F.try_divide((e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]), e["q"]["y"] - e["p"]["y"]) + e["p"]["x"]
    )
    inside = F.aggregate(edges, F.lit(False), lambda acc, e: acc != F.coalesce(hit(e), F.lit(False)))
    return F.when(polygon.isNull(), True).when(F.size(polygon) == 0, False).otherwise(inside)


def side_of_line(x1: Column, y1: Column, x2: Column, y2: Column, px: Column, py: Column) -> Column:
    """Cross product; its sign tells the side of the line through both points."""
    return (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)


def crossing_direction(before: Column, after: Column) -> Column:
    """+1 or -1 where the side changes; null on the same side, or if a point is exactly on the line."""
    return F.when(before * after < 0, F.when(before < 0, 1).otherwise(-1))


def crossing_kind(junction_side: Column, direction: Column) -> Column:
    inward = F.when(junction_side == "left", 1).otherwise(-1)
    return F.when(direction == inward, "entry").otherwise("exit")


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point to a segment, to its end if the foot is outside, to the start if it has no length."""
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    along = F.when(square < 1e-12, 0.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((px - x1) * dx + (py - y1) * dy, square)))
    )
    return distance(px, py, x1 + along * dx, y1 + along * dy)


def ray_hit(px: Column, py: Column, hx: Column, hy: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """How far along the heading (in headings) a ray meets a segment; null if it does not."""
    sx, sy = x2 - x1, y2 - y1
    across = hx * sy - hy * sx
    t = F.try_divide((x1 - px) * sy - (y1 - py) * sx, across)
    u = F.try_divide((x1 - px) * hy - (y1 - py) * hx, across)
    return F.when((F.abs(across) >= 1e-12) & (t >= 0) & u.between(0, 1), t)


def angle_between(ax: Column, ay: Column, bx: Column, by_: Column) -> Column:
    """Degrees between two headings; 0 if one has no length."""
    na, nb = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by_ * by_)
    cosine = F.try_divide(ax * bx + ay * by_, na * nb)
    return F.when((na < 1e-9) | (nb < 1e-9), 0.0).otherwise(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def corners(cx: Column, cy: Column, w: Column, h: Column) -> list[Column]:
    """Centre and size to (x1, y1, x2, y2)."""
    return [cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2]


def iou(a: list[Column], b: list[Column], eps: float, floor: bool = False) -> Column:
    """Overlap of two boxes of corners. ``eps`` is added to the union, or with ``floor`` is its least value."""
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    tall = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    both = wide * tall
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / (F.greatest(union, F.lit(eps)) if floor else union + eps)


def clip_unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def letterbox(width: Column, height: Column, target: int) -> tuple[Column, Column, Column]:
    """Scale and the left and upper padding, in whole pixels, that fit an image into a square."""
    scale = F.least(F.lit(float(target)) / width, F.lit(float(target)) / height)
    pad = lambda side: F.floor((target - F.floor(side * scale)) / 2)
    return scale, pad(width), pad(height)


def from_letterbox(box: list[Column], width: Column, height: Column, target: int) -> list[Column]:
    """A box x1, y1, x2, y2 on the square as one of the image, clipped to it."""
    scale, left, top = letterbox(width, height, target)
    clip = lambda v, pad, most: F.least(F.greatest((v - pad) / scale, F.lit(0.0)), most.cast("double"))
    return [clip(v, *((left, width) if k % 2 == 0 else (top, height))) for k, v in enumerate(box)]


def snapshot_crop(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """The square picture of a box: its ``side``, the part of the frame that is copied (``src_x1`` to ``src_y2``) and where to (``dst_x``, ``dst_y``).

    The side is the longer one of the box. The shorter one is widened on both sides until the box fills half of the scene, or
    the square; what then remains of the square, and what lies outside the frame, stays black. Null for an empty box; a box outside
    the frame has an empty part."""
    x, y, w, h = (v.cast("long") for v in (x, y, w, h))
    side, short = F.greatest(w, h), F.least(w, h)
    scene = F.least(short + 2 * F.ceil(short / 2), side)
    before, after = F.floor((scene - short) / 2), F.ceil((scene - short) / 2)
    pad, wide = F.floor((side - scene) / 2), w >= h
    left, right = F.when(wide, x).otherwise(x - before), F.when(wide, x + w).otherwise(x + w + after)
    top, low = F.when(wide, y - before).otherwise(y), F.when(wide, y + h + after).otherwise(y + h)
    src = {"src_x1": F.greatest(left, F.lit(0)), "src_y1": F.greatest(top, F.lit(0)), "src_x2": F.least(right, width), "src_y2": F.least(low, height)}
    dst = {"dst_x": F.when(wide, 0).otherwise(pad) + src["src_x1"] - left, "dst_y": F.when(wide, pad).otherwise(0) + src["src_y1"] - top}
    return {k: F.when((w > 0) & (h > 0), v).cast("long") for k, v in {"side": side, **src, **dst}.items()}


def contain_fit(px: Column, py: Column, image: tuple[Column, Column], shown: tuple[Column, Column]) -> tuple[Column, Column]:
    """Display coordinates to image coordinates of an image shown whole inside a box; null beside the image."""
    scale = F.least(shown[0] / image[0], shown[1] / image[1])
    x = (px - (shown[0] - image[0] * scale) / 2) / scale
    y = (py - (shown[1] - image[1] * scale) / 2) / scale
    inside = x.between(0, image[0]) & y.between(0, image[1])
    return F.when(inside, x), F.when(inside, y)


def contain_fit_back(x: Column, y: Column, image: tuple[Column, Column], shown: tuple[Column, Column]) -> tuple[Column, Column]:
    """Image coordinates to display coordinates."""
    scale = F.least(shown[0] / image[0], shown[1] / image[1])
    return x * scale + (shown[0] - image[0] * scale) / 2, y * scale + (shown[1] - image[1] * scale) / 2


def closes(x: Column, y: Column, first_x: Column, first_y: Column, corners: Column, pixels: float) -> Column:
    """Does a click near the first of three corners or more close the polygon?"""
    return (corners >= 3) & (distance(x, y, first_x, first_y) < pixels)


def centroid(polygon: Column) -> tuple[Column, Column]:
    """The mean of an array of corners (x, y); null if there is none."""
    mean = lambda c: F.try_divide(F.aggregate(polygon, F.lit(0.0), lambda s, p: s + p[c]), F.size(polygon))
    return mean("x"), mean("y")


def cosine(a: Column, b: Column) -> Column:
    """Cosine distance of two arrays, at least 0."""
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    return F.greatest(F.lit(0.0), 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
