"""Joins of a page's boxes, as expressions and Arrow functions over the page's arrays: no row leaves its page, nothing is shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import text as T
from pagewright.schema import LIMITS, LINK_GOTO, LINK_URI, RECT


def first_cover(inner: Column, outers: Column, rect=lambda o: o) -> Column:
    """Index of the first of outers that holds more than half of inner, else null. rect: an outer's rectangle."""
    hits = F.transform(outers, lambda o, i: F.when(G.covered(inner, rect(o), LIMITS.covered), i))
    return F.array_min(hits)


def is_covered(inner: Column, outers: Column) -> Column:
    return F.exists(outers, lambda o: G.covered(inner, o, LIMITS.covered))


def components(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, tolerance: float) -> np.ndarray:
    """For each rectangle the least place among those it is connected to, where two touch within the tolerance, edges included.

    A sweep from the left. For each height at which some rectangle begins or ends, the one that reaches furthest to the right is kept, of all that cover it:
    what still reaches a new rectangle there is connected to the kept one already.
    """
    n = len(x0)
    low, high = y0, y1 + tolerance
    heights = np.unique(np.concatenate((low, high)))
    first, last = np.searchsorted(heights, low), np.searchsorted(heights, high) + 1
    reach, owner, up = np.full(len(heights), -np.inf), np.zeros(len(heights), np.int64), np.arange(n)

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i in np.argsort(x0, kind="stable").tolist():
        part = slice(first[i], last[i])
        met = owner[part][reach[part] >= x0[i]]
        if len(met):
            # neighbours at most heights have the same owner
            for j in np.unique(met).tolist() if len(met) > 8 else set(met.tolist()):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
        own = x1[i] + tolerance
        further = reach[part] < own
        reach[part][further], owner[part][further] = own, i
    return np.array([root(i) for i in range(n)], np.int64)


def _merged(tolerance: float):
    def run(rects: pa.Array) -> pa.Array:
        offsets, flat = rects.offsets.to_numpy() - rects.offsets[0].as_py(), rects.flatten()
        sides = [flat.field(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")]
        found, counts = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = [s[a:b] for s in sides]
            _, group = np.unique(components(*own, tolerance), return_inverse=True) if b > a else (None, np.zeros(0, np.int64))
            m = int(group.max()) + 1 if b > a else 0
            box = [np.full(m, np.inf), np.full(m, np.inf), np.full(m, -np.inf), np.full(m, -np.inf)]
            for k in range(4):
                (np.minimum if k < 2 else np.maximum).at(box[k], group, own[k])
            found.append(box)
            counts.append(m)
        sides = [pa.array(np.concatenate([f[k] for f in found]) if found else np.zeros(0), pa.float64()) for k in range(4)]
        ends = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(sides, ["x0", "y0", "x1", "y1"]))

    return run


def merge_touching(rects: Column, tolerance: float = LIMITS.touch_pt) -> Column:
    """Bounding boxes of the connected components of rectangles that touch within the tolerance, by their first member's place; null counts as none.

    An Arrow function, as a page of vector art has tens of thousands of them and the JVM's folds copy what they have so far: it can't stand within a lambda.
    """
    sweep = F.arrow_udf(_merged(tolerance), f"array<{RECT}>")
    known = F.filter(F.coalesce(rects.cast(f"array<{RECT}>"), F.array().cast(f"array<{RECT}>")), lambda r: r["x0"].isNotNull() & r["y0"].isNotNull() & r["x1"].isNotNull() & r["y1"].isNotNull())
    return sweep(known)


def callout_boxes(drawings: Column, images: Column, page_width: Column) -> Column:
    """Boxes drawn on a page: touching drawings merged, but those of the page's width, too small, or a frame around an image."""
    lines = F.filter(drawings, lambda r: (G.width(r) >= 0.5) | (G.height(r) >= 0.5))

    def plausible(r: Column) -> Column:
        framed = F.exists(images, lambda i: G.covered(r, i, LIMITS.callout_image))
        return (G.width(r) < page_width * LIMITS.callout_width) & (G.height(r) >= LIMITS.callout_size) & (G.width(r) >= LIMITS.callout_size) & ~framed

    return F.filter(merge_touching(lines), plausible)


def page_links(links: Column) -> Column:
    """array<struct<rect, href>>: URIs, and #page-N of links within the document (page counts from 0 there)."""
    href = lambda x: F.when((x["kind"] == LINK_URI) & (F.length(x["uri"]) > 0), x["uri"]).when((x["kind"] == LINK_GOTO) & (x["page"] >= 0), F.concat(F.lit("#page-"), (x["page"] + 1).cast("string")))
    found = F.transform(links, lambda x: F.struct(x["rect"].alias("rect"), href(x).alias("href")))
    return F.filter(found, lambda x: x["href"].isNotNull())


def column_gap(rects: Column, least_blocks: int) -> Column:
    """struct(left, right), the gutter between two columns of blocks, or null.

    The blocks, by x0, part at the widest step (of equal ones the last) if it is wide enough in itself and against the others'
    upper median, and if half of the smaller side's blocks run beside a block of the other.
    """
    ordered = F.array_sort(rects)
    n = F.size(rects)

    def found(o: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct((F.get(o, i)["x0"] - F.get(o, i - 1)["x0"]).alias("d"), i.alias("i")))
        widest = F.array_max(steps)
        return F.struct(o.alias("o"), widest["d"].alias("d"), widest["i"].alias("i"), F.transform(F.filter(steps, lambda s: s["i"] != widest["i"]), lambda s: s["d"]).alias("others"))

    def sides(f: Column) -> Column:
        median = F.when(F.size(f["others"]) > 0, G.upper_median(f["others"]))
        wide = (f["d"] >= LIMITS.column_gap_pt) & ~F.coalesce((median > 0) & (f["d"] < median * LIMITS.split_gap_ratio), F.lit(False))
        return F.when(wide, F.struct(F.slice(f["o"], F.lit(1), f["i"]).alias("l"), F.slice(f["o"], f["i"] + 1, n).alias("r")))

    def gutter(s: Column) -> Column:
        def beside(a: Column, b: Column) -> Column:
            met = F.filter(a, lambda x: F.exists(b, lambda y: (x["y0"] < y["y1"]) & (y["y0"] < x["y1"])))
            return F.size(met) >= F.size(a) * LIMITS.sibling_share

        parallel = F.when(F.size(s["l"]) <= F.size(s["r"]), beside(s["l"], s["r"])).otherwise(beside(s["r"], s["l"]))
        left, right = F.array_max(F.transform(s["l"], lambda x: x["x1"])), F.array_min(F.transform(s["r"], lambda x: x["x0"]))
        return F.when(parallel & (right > left), F.struct(left.alias("left"), right.alias("right")))

    bound = F.transform(F.transform(F.transform(F.array(ordered), found), sides), gutter)
    return F.when(n >= max(2, least_blocks), F.element_at(bound, 1))


def page_gutter(texts: Column, height: Column, callouts: Column) -> Column:
    """Of a page's text rectangles that are neither in the margin zones nor in a callout."""
    flow = F.filter(texts, lambda r: ~T.in_margin_zone(r["y0"], r["y1"], height) & ~is_covered(r, callouts))
    return column_gap(flow, 4)


def callout_gutter(texts: Column, box: Column) -> Column:
    """Within a callout box, its wide title left out."""
    inner = F.filter(texts, lambda r: G.covered(r, box, LIMITS.covered) & ~((G.width(box) > 0) & (G.width(r) > G.width(box) * LIMITS.title_width)))
    return column_gap(inner, 2)
