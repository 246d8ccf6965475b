"""Geometry of boxes (arrays of points) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bbox(box: Column) -> Column:
    xs, ys = F.transform(box, lambda p: p[0]), F.transform(box, lambda p: p[1])
    return F.struct(
        F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2")
    )


def center(b: Column) -> Column:
    return F.struct(((b["x1"] + b["x2"]) / 2).alias("x"), ((b["y1"] + b["y2"]) / 2).alias("y"))


def area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    """Area of the overlap, with sides truncated to whole pixels."""
    w = F.floor(F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0)))
    h = F.floor(F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0)))
    return (w * h).cast("double")


def overlap_of_smaller(a: Column, b: Column) -> Column:
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection(a, b) / least).otherwise(0.0)


def cover_share(a: Column, b: Column) -> Column:
    """Share of ``a`` that ``b`` covers."""
    return F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(0.0)


def gap(a: Column, b: Column) -> Column:
    """Distance between two boxes along the axis that parts them, 0 if they touch."""
    dx = F.greatest(F.lit(0.0), F.greatest(a["x1"], b["x1"]) - F.least(a["x2"], b["x2"]))
    dy = F.greatest(F.lit(0.0), F.greatest(a["y1"], b["y1"]) - F.least(a["y2"], b["y2"]))
    return F.sqrt(dx * dx + dy * dy)


def x_overlap_ratio(a: Column, b: Column) -> Column:
    inter = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    return inter / F.greatest(F.lit(1.0), F.least(a["x2"] - a["x1"], b["x2"] - b["x1"]))


def y_overlap_ratio(a: Column, b: Column) -> Column:
    inter = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    return inter / F.greatest(F.lit(1.0), F.least(a["y2"] - a["y1"], b["y2"] - b["y1"]))


def same_line(a: Column, b: Column) -> Column:
    height = F.least(a["y2"] - a["y1"], b["y2"] - b["y1"])
    return F.abs(center(a)["y"] - center(b)["y"]) <= F.greatest(F.lit(5.0), 0.3 * height)


def angle(box: Column) -> Column:
    """Degrees of the first side of a polygon against the horizontal."""
    p, q = F.element_at(box, 1), F.element_at(box, 2)
    return F.degrees(F.atan2(q[1] - p[1], q[0] - p[0]))


def contains_center(outer: Column, inner: Column) -> Column:
    c = center(inner)
    return c["x"].between(outer["x1"], outer["x2"]) & c["y"].between(outer["y1"], outer["y2"])
