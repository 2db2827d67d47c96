"""Tables found from what a page shows: ruled ones from their lines, others from the white space between aligned spans.

Ruled: thin drawings, and the edges of filled ones, are rulings; those that touch make a grid, whose lines are their places, near ones taken
for one. Faces of the grid that no ruling parts are one cell, with its text in its first face. Aligned: spans make rows; a run of rows keeps the
gutters that all of them leave free, and is a table if it has enough rows of several cells, which are short, or lies between rulings. All are expressions over
a page's arrays: a page's tables are found in its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import text as T
from pagewright.functions.steps import deep_folds, once
from pagewright.operators import ocr, spatial
from pagewright.schema import BOX, LIMITS, RAW_TABLE, RECT

#: Points: the greatest thickness of a ruling, the distance within which rulings are one line, the least gutter, and how many heights of a row may part it from the next.
THICK, SNAP, GUTTER, NEAR = 2.0, LIMITS.touch_pt, 9.0, 2.0
#: Characters of a cell, in the middle one of an aligned table; rows with two cells or more, without and with rulings around.
CELL_CHARS, LEAST_ROWS, LEAST_RULED_ROWS = 40, 3, 2
GAP = "struct<l:double,r:double>"
RUN_OF_ROWS = f"struct<rows:array<array<{BOX}>>,gutters:array<{GAP}>,y1:double>"


def _bind(value: Column, *steps) -> Column:
    """steps applied one after another, each value made once."""
    bound = F.array(value)
    for step in steps:
        bound = F.transform(bound, step)
    return F.element_at(bound, 1)


def _empty(ddl: str) -> Column:
    return F.array().cast(f"array<{ddl}>")


def rulings(drawings: Column) -> Column:
    """array<RECT>: thin drawings as they are, and the four edges of others."""

    def edges(r: Column) -> Column:
        x0, y0, x1, y1 = (r[n] for n in ("x0", "y0", "x1", "y1"))
        thin = (G.width(r) <= THICK) | (G.height(r) <= THICK)
        return F.when(thin, F.array(G.rect(x0, y0, x1, y1))).otherwise(F.array(G.rect(x0, y0, x1, y0), G.rect(x0, y1, x1, y1), G.rect(x0, y0, x0, y1), G.rect(x1, y0, x1, y1)))

    long = F.filter(drawings, lambda r: (G.width(r) > THICK) | (G.height(r) > THICK))
    return F.flatten(F.transform(long, edges))


def _level(r: Column) -> Column:
    return (G.height(r) <= THICK) & (G.width(r) > THICK)


def _upright(r: Column) -> Column:
    return (G.width(r) <= THICK) & (G.height(r) > THICK)


def _mid(r: Column, side: str) -> Column:
    return (r[f"{side}0"] + r[f"{side}1"]) / 2


def snapped(values: Column) -> Column:
    """Sorted values without those within SNAP of the one kept before."""

    def step(acc: Column, v: Column) -> Column:
        return F.when((F.size(acc) > 0) & (v - F.get(acc, F.size(acc) - 1) <= SNAP), acc).otherwise(F.concat(acc, F.array(v)))

    return F.aggregate(F.array_sort(values), _empty("double"), step)


def _between(v: Column, a: Column, b: Column, slack: float = 0.0) -> Column:
    return (v >= a - slack) & (v < b + slack)


def _pieces(text_blocks: Column) -> Column:
    """Lines of a page's spans, each span with its centre: array<array<struct<text, x, y>>>."""
    centre = lambda s: F.struct(s["text"].alias("text"), ((s["bbox"][0] + s["bbox"][2]) / 2).alias("x"), ((s["bbox"][1] + s["bbox"][3]) / 2).alias("y"))
    return F.flatten(F.transform(text_blocks, lambda b: F.transform(b["lines"], lambda line: F.transform(line["spans"], centre))))


def _text_in(pieces: Column, r: Column) -> Column:
    """Text of the spans whose centre is in a rectangle, a line a line."""
    inside = lambda s: _between(s["x"], r["x0"], r["x1"]) & _between(s["y"], r["y0"], r["y1"])
    lines = F.transform(pieces, lambda line: F.array_join(F.transform(F.filter(line, inside), lambda s: s["text"]), ""))
    return F.array_join(F.filter(lines, lambda t: ~T.blank(t)), "\n")


def ruled_tables(text_blocks: Column, drawings: Column, boxes: Column) -> Column:
    """array<RAW_TABLE> of grids of two rows and columns or more; boxes: those of the rulings that touch. A cell of several faces has its text in the first of them, null in the others."""

    def grid(lines: Column, box: Column) -> Column:
        own = F.filter(lines, lambda r: _between(_mid(r, "x"), box["x0"], box["x1"], SNAP) & _between(_mid(r, "y"), box["y0"], box["y1"], SNAP))
        level, upright = F.filter(own, _level), F.filter(own, _upright)
        xs, ys = snapped(F.transform(upright, lambda r: _mid(r, "x"))), snapped(F.transform(level, lambda r: _mid(r, "y")))
        return F.struct(level.alias("level"), upright.alias("upright"), xs.alias("xs"), ys.alias("ys"))

    def cells(g: Column, pieces: Column) -> Column:
        n, m = F.size(g["xs"]) - 1, F.size(g["ys"]) - 1
        x, y = (lambda c: F.get(g["xs"], c)), (lambda r: F.get(g["ys"], r))

        def parted_x(r: Column, c: Column) -> Column:
            """Whether a ruling stands at grid line c beside row r."""
            at, middle = x(c), (y(r) + y(r + 1)) / 2
            return (c == 0) | (c == n) | F.exists(g["upright"], lambda v: (F.abs(_mid(v, "x") - at) <= SNAP) & _between(middle, v["y0"], v["y1"], SNAP))

        def parted_y(r: Column, c: Column) -> Column:
            at, middle = y(r), (x(c) + x(c + 1)) / 2
            return (r == 0) | (r == m) | F.exists(g["level"], lambda v: (F.abs(_mid(v, "y") - at) <= SNAP) & _between(middle, v["x0"], v["x1"], SNAP))

        def face(r: Column, c: Column) -> Column:
            right = F.array_min(F.filter(F.sequence(c + 1, n), lambda k: parted_x(r, k)))
            below = F.array_min(F.filter(F.sequence(r + 1, m), lambda k: parted_y(k, c)))
            text = _bind(G.rect(x(c), y(r), x(right), y(below)), lambda box: _text_in(pieces, box))
            return F.when(parted_x(r, c) & parted_y(r, c), text)

        return F.transform(F.sequence(F.lit(0), m - 1), lambda r: F.transform(F.sequence(F.lit(0), n - 1), lambda c: face(r, c)))

    def found(lines: Column) -> Column:
        grids = F.filter(F.transform(boxes, lambda box: grid(lines, box)), lambda g: (F.size(g["xs"]) > LIMITS.table_size) & (F.size(g["ys"]) > LIMITS.table_size))
        box = lambda g: G.rect(F.array_min(g["xs"]), F.array_min(g["ys"]), F.array_max(g["xs"]), F.array_max(g["ys"]))
        return _bind(_pieces(text_blocks), lambda pieces: F.transform(grids, lambda g: F.struct(box(g).alias("bbox"), cells(g, pieces).alias("rows")).cast(RAW_TABLE)))

    return _bind(rulings(drawings), found)


def _segments(text_blocks: Column, taken: Column) -> Column:
    """BOXes of spans that aren't blank, nor in a rectangle of `taken`; neighbours of a line that no gutter parts are one."""

    def line_boxes(line: Column) -> Column:
        spans = F.filter(line["spans"], lambda s: ~T.blank(s["text"]))
        boxes = F.transform(spans, lambda s: F.struct(s["bbox"][0].alias("x0"), s["bbox"][2].alias("x1"), s["bbox"][1].alias("y0"), s["bbox"][3].alias("y1"), s["text"].alias("text")).cast(BOX))

        def step(acc: Column, b: Column) -> Column:
            last = F.get(acc, F.size(acc) - 1)
            one = F.struct(last["x0"].alias("x0"), F.greatest(last["x1"], b["x1"]).alias("x1"), F.least(last["y0"], b["y0"]).alias("y0"), F.greatest(last["y1"], b["y1"]).alias("y1"), F.concat(last["text"], b["text"]).alias("text")).cast(BOX)
            near = (F.size(acc) > 0) & (b["x0"] - last["x1"] < GUTTER) & (b["x0"] >= last["x0"])
            return F.when(near, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(one))).otherwise(F.concat(acc, F.array(b)))

        return F.aggregate(boxes, _empty(BOX), step)

    all_ = F.flatten(F.transform(text_blocks, lambda b: F.flatten(F.transform(b["lines"], line_boxes))))
    free = lambda b: ~spatial.is_covered(G.rect(b["x0"], b["y0"], b["x1"], b["y1"]), taken)
    return F.filter(all_, free)


def _free(row: Column) -> Column:
    """What a row's boxes, from the left, leave free, the ends of the page included; parts narrower than a gutter aside."""
    n, edge = F.size(row), 1e9
    gap = lambda i: F.struct(F.when(i == 0, F.lit(-edge)).otherwise(F.get(row, i - 1)["x1"]).alias("l"), F.when(i == n, F.lit(edge)).otherwise(F.get(row, i)["x0"]).alias("r")).cast(GAP)
    return F.filter(F.transform(F.sequence(F.lit(0), n), gap), lambda g: g["r"] - g["l"] >= GUTTER)


def _inner(gaps: Column) -> Column:
    return F.filter(gaps, lambda g: (g["l"] > -1e8) & (g["r"] < 1e8))


def _shared(a: Column, b: Column) -> Column:
    """Where gaps of both are free, a gutter wide or more."""
    both = F.flatten(F.transform(a, lambda g: F.transform(b, lambda h: F.struct(F.greatest(g["l"], h["l"]).alias("l"), F.least(g["r"], h["r"]).alias("r")).cast(GAP))))
    return F.filter(both, lambda g: g["r"] - g["l"] >= GUTTER)


def aligned_tables(rows: Column, drawings: Column) -> Column:
    """array<RAW_TABLE> of runs of rows, as group_rows() makes them of _segments(), with common gutters.

    A row of several cells goes on in a run whose gutters it leaves free in part; a row of one cell if it crosses none of them. Rows further apart than NEAR heights begin anew.
    """

    def by_left(g: Column) -> Column:
        keyed = F.array_sort(F.transform(g["boxes"], lambda b: F.struct(b["x0"].alias("x0"), b.alias("b"))))
        return F.transform(keyed, lambda k: k["b"])

    def bottom(row: Column) -> Column:
        return F.array_max(F.transform(row, lambda b: b["y1"]))

    def top(row: Column) -> Column:
        return F.array_min(F.transform(row, lambda b: b["y0"]))

    def step(runs: Column, row: Column) -> Column:
        last = F.get(runs, F.size(runs) - 1)
        left = F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0)))

        def next_(free: Column) -> Column:
            kept = _shared(last["gutters"], free)
            near = top(row) - last["y1"] <= (bottom(row) - top(row)) * NEAR
            goes_on = (F.size(runs) > 0) & near & (F.size(kept) > 0) & ((F.size(row) > 1) | (F.size(kept) == F.size(last["gutters"])))
            longer = F.struct(F.concat(last["rows"], F.array(row)).alias("rows"), kept.alias("gutters"), bottom(row).alias("y1")).cast(RUN_OF_ROWS)
            fresh = F.struct(F.array(row).alias("rows"), _inner(free).alias("gutters"), bottom(row).alias("y1")).cast(RUN_OF_ROWS)
            return F.when(F.coalesce(goes_on, F.lit(False)), F.concat(left, F.array(longer))).otherwise(F.concat(runs, F.array(fresh)))

        return _bind(_free(row), next_)

    def bounds(rows: Column) -> Column:
        return G.bounds(F.transform(F.flatten(rows), lambda b: G.rect(b["x0"], b["y0"], b["x1"], b["y1"])))

    def trimmed(run: Column) -> Column:
        """Rows of one cell at the end are no part of it."""
        last = F.array_max(F.transform(run["rows"], lambda r, i: F.when(F.size(r) > 1, i)))
        return F.struct(F.slice(run["rows"], F.lit(1), F.coalesce(last + 1, F.lit(0))).alias("rows"), run["gutters"].alias("gutters"))

    def judged(lines: Column, run: Column) -> Column:
        several = F.size(F.filter(run["rows"], lambda r: F.size(r) > 1))
        chars = G.upper_median(F.transform(F.flatten(run["rows"]), lambda b: F.length(b["text"])))

        def table(box: Column) -> Column:
            beside = lambda r: _level(r) & (r["x0"] <= box["x0"] + GUTTER) & (r["x1"] >= box["x1"] - GUTTER)
            height = G.height(box)
            around = F.exists(lines, lambda r: beside(r) & (_mid(r, "y") <= box["y0"] + THICK) & (_mid(r, "y") >= box["y0"] - height)) & F.exists(lines, lambda r: beside(r) & (_mid(r, "y") >= box["y1"] - THICK) & (_mid(r, "y") <= box["y1"] + height))
            enough = (several >= LEAST_ROWS) & (chars <= CELL_CHARS) | (several >= LEAST_RULED_ROWS) & around
            places = F.transform(run["gutters"], lambda g: (g["l"] + g["r"]) / 2)
            columns = F.sequence(F.lit(0), F.size(places))
            at = lambda b: F.size(F.filter(places, lambda p: p < (b["x0"] + b["x1"]) / 2))
            rows = F.transform(run["rows"], lambda row: F.transform(columns, lambda c: F.array_join(F.transform(F.filter(row, lambda b: at(b) == c), lambda b: b["text"]), " ")))
            return F.when(enough, F.struct(box.alias("bbox"), rows.alias("rows")).cast(RAW_TABLE))

        return _bind(bounds(run["rows"]), table)

    def found(rows: Column) -> Column:
        runs = F.aggregate(F.transform(rows, by_left), _empty(RUN_OF_ROWS), step)
        some = F.filter(F.transform(runs, trimmed), lambda r: (F.size(r["rows"]) >= LIMITS.table_size) & (F.size(r["gutters"]) > 0))
        return _bind(rulings(drawings), lambda lines: F.filter(F.transform(some, lambda r: judged(lines, r)), lambda t: t.isNotNull()))

    return _bind(rows, found)


def find_tables(pages: DataFrame, aligned: bool = False) -> DataFrame:
    """pages (RAW_PAGE) with their tables where raw_tables is null: ruled ones and, if asked for, aligned ones, from the top.

    An array of raw_tables that is there already stays, an empty one too: it says that there are none. Cells' texts are as they are on the page;
    tables.clean_table() cleans them. A page without blocks or drawings, or with null ones, has no ruled table.
    """
    kind = {c: pages.schema[c].dataType for c in ("blocks", "drawings", "raw_tables")}
    look = F.col("raw_tables").isNull()
    drawn = F.when(look, F.coalesce("drawings", F.array().cast(kind["drawings"]))).otherwise(F.array().cast(kind["drawings"]))
    texts = F.filter(F.coalesce("blocks", F.array().cast(kind["blocks"])), lambda b: b["type"] == 0)
    d = once(pages, "_boxes", spatial.merge_touching(rulings(drawn)))
    all_drawn = F.coalesce("drawings", F.array().cast(kind["drawings"]))

    def sorted_(all_: Column) -> Column:
        keyed = F.array_sort(F.transform(all_, lambda t, i: F.struct(t["bbox"]["y0"].alias("y"), t["bbox"]["x0"].alias("x"), i.alias("i"))))
        return F.transform(keyed, lambda k: F.get(all_, k["i"]))

    with deep_folds(pages.sparkSession):
        ruled = F.col("_ruled")
        d = once(d, "_ruled", F.when(look, ruled_tables(texts, drawn, F.col("_boxes"))))
        if aligned:
            # a column of its own: with this expression for its argument, Spark was seen to leave the function in the plan, where it can't be evaluated
            d = once(d, "_segments", F.when(look, _segments(texts, F.transform(ruled, lambda t: t["bbox"]))))
            d = once(d, "_rows", ocr.group_rows(F.col("_segments")))
        found = _bind(F.concat(ruled, aligned_tables(F.col("_rows"), all_drawn)) if aligned else ruled, sorted_).cast(kind["raw_tables"])
        return once(d, "raw_tables", F.when(look, found).otherwise(F.col("raw_tables"))).select(*pages.columns)
