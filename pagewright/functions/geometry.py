"""Rectangles, struct<x0,y0,x1,y1>, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x0, y0, x1, y1) -> Column:
    return F.struct(*[c.cast("double").alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)])


def from_array(bbox: Column) -> Column:
    return rect(bbox[0], bbox[1], bbox[2], bbox[3])


def width(r: Column) -> Column:
    return r["x1"] - r["x0"]


def height(r: Column) -> Column:
    return r["y1"] - r["y0"]


def area(r: Column) -> Column:
    return width(r) * height(r)


def overlap(a: Column, b: Column) -> Column:
    """Area of the intersection; 0 if it is empty."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def covered(inner: Column, outer: Column, share: float = 0.5) -> Column:
    """More than `share` of inner lies in outer; never for an inner without area."""
    return (area(inner) > 0) & (overlap(inner, outer) > area(inner) * share)


def touches(a: Column, b: Column, tolerance: float) -> Column:
    """a, grown by the tolerance, meets b, edges included."""
    return (a["x0"] - tolerance <= b["x1"]) & (b["x0"] <= a["x1"] + tolerance) & (a["y0"] - tolerance <= b["y1"]) & (b["y0"] <= a["y1"] + tolerance)


def bounds(rects: Column) -> Column:
    """The bounding box of an array of rectangles."""

    def side(name: str) -> Column:
        return F.transform(rects, lambda r: r[name])

    return rect(F.array_min(side("x0")), F.array_min(side("y0")), F.array_max(side("x1")), F.array_max(side("y1")))


def vertical_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two y-ranges over their union; 0 if they are apart."""
    both = F.least(a1, b1) - F.greatest(a0, b0)
    union = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when((both > 0) & (union > 0), both / union).otherwise(F.lit(0.0))


def upper_median(values: Column) -> Column:
    """The middle of the sorted values, the greater of two; null of none."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))
