"""Columns over boxes: structs of x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*(v.cast("double").alias(k) for k, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))))


def width(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"])


def height(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def area(b: Column) -> Column:
    return width(b) * height(b)


def center_x(b: Column) -> Column:
    return (b["x0"] + b["x1"]) / 2


def center_y(b: Column) -> Column:
    return (b["y0"] + b["y1"]) / 2


def overlap(a: Column, b: Column) -> Column:
    """The common area; 0 where the boxes only touch."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    inter = overlap(a, b)
    whole = area(a) + area(b) - inter
    return F.when((inter > 0) & (whole > 0), inter / whole).otherwise(F.lit(0.0))


def contains(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x0"]) & (a["y0"] <= b["y0"]) & (a["x1"] >= b["x1"]) & (a["y1"] >= b["y1"])


def merge(a: Column, b: Column) -> Column:
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def envelope(b: Column) -> Column:
    """Aggregate: the box around all boxes of a group."""
    return box(F.min(b["x0"]), F.min(b["y0"]), F.max(b["x1"]), F.max(b["y1"]))


def distance(a: Column, b: Column) -> Column:
    dx, dy = center_x(a) - center_x(b), center_y(a) - center_y(b)
    return F.sqrt(dx * dx + dy * dy)


def reading_key(b: Column) -> Column:
    """Bands of 20 points, then left to right."""
    return F.struct(F.rint(b["y0"] / 20) * 20, b["x0"])


def horizontal_overlap(a: Column, b: Column) -> Column:
    common = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    least = F.least(width(a), width(b))
    return F.when(least > 0, common / least).otherwise(F.lit(0.0))


def vertical_gap(a: Column, b: Column) -> Column:
    return b["y0"] - a["y1"]


def has_point(b: Column, x: Column, y: Column) -> Column:
    return x.between(b["x0"], b["x1"]) & y.between(b["y0"], b["y1"])


def relative_position(a: Column, b: Column) -> Column:
    """Where a lies, seen from b: the axis on which the centres are further apart decides, the vertical one in a tie."""
    dx, dy = center_x(a) - center_x(b), center_y(a) - center_y(b)
    vertical = F.abs(dy) >= F.abs(dx)
    return F.when(overlap(a, b) > 0, "overlapping").when(vertical & (dy < 0), "above").when(vertical, "below").when(dx < 0, "left").otherwise("right")


def aspect_ratio(b: Column) -> Column:
    return F.when(height(b) > 0, width(b) / height(b)).otherwise(F.lit(0.0))


def grid_position(b: Column, page_width: Column, page_height: Column) -> Column:
    """The third of the page, across and down, in which the centre lies: a struct of col and row."""
    third = lambda v, whole: F.greatest(F.lit(0), F.least(F.lit(2), F.floor(v / whole * 3).cast("int")))
    across, down = F.array(*map(F.lit, ("left", "center", "right"))), F.array(*map(F.lit, ("top", "middle", "bottom")))
    return F.struct(F.get(across, third(center_x(b), page_width)).alias("col"), F.get(down, third(center_y(b), page_height)).alias("row"))


def non_maximum_suppression(boxes: Column, threshold: float) -> Column:
    """Of an array of (idx, bbox): largest first, those that overlap no kept one by the threshold or more."""
    ordered = F.transform(
        F.array_sort(F.transform(boxes, lambda x: F.struct((-area(x["bbox"])).alias("a"), x["idx"].alias("idx"), x["bbox"].alias("bbox")))),
        lambda x: F.struct(x["idx"].alias("idx"), x["bbox"].alias("bbox")),
    )
    return F.aggregate(
        ordered,
        F.slice(ordered, 1, 0),
        lambda kept, x: F.when(F.exists(kept, lambda k: iou(k["bbox"], x["bbox"]) >= threshold), kept).otherwise(F.concat(kept, F.array(x))),
    )
