"""Tables found on pages: grids with merged cells, tables between rulings, tables of white space alone, and what is none."""

import numpy as np
import pytest

from pagewright.operators import pages, spatial, table_finder
from pagewright.schema import RAW_PAGE


def rect(*sides):
    return dict(zip(("x0", "y0", "x1", "y1"), map(float, sides)))


def span(text, x, y, width=None):
    return {"text": text, "size": 10.0, "font": "Serif", "flags": 0, "bbox": [float(x), float(y), float(x + (width or 5 * len(text or ""))), float(y + 10)]}


def block(spans):
    sides = list(zip(*[s["bbox"] for s in spans]))
    return {"type": 0, "bbox": [min(sides[0]), min(sides[1]), max(sides[2]), max(sides[3])], "lines": [{"spans": [s]} for s in spans]}


def level(y, x0, x1):
    return rect(x0, y, x1, y + 0.5)


def upright(x, y0, y1):
    return rect(x, y0, x + 0.5, y1)


def found(spark, blocks, drawings, aligned=True, given=None):
    page = (1, 1, 600.0, 800.0, blocks, drawings, [], given, [])
    return [t.rows for t in table_finder.find_tables(spark.createDataFrame([page], RAW_PAGE), aligned).first().raw_tables]


CELLS = [span(f"r{r}c{c}", 55 + 100 * c, 105 + 20 * r) for r in range(3) for c in range(3)]
GRID = [level(100 + 20 * k, 50, 350) for k in range(4)] + [upright(50 + 100 * k, 100, 160) for k in range(4)]


def test_grid(spark):
    whole = [[f"r{r}c{c}" for c in range(3)] for r in range(3)]
    assert found(spark, [block(CELLS)], GRID, False) == [whole]
    # rulings in pieces, which meet nearly, and twice
    pieces = [rect(d["x0"], d["y0"], (d["x0"] + d["x1"]) / 2, d["y1"]) for d in GRID[:4]] + [rect((d["x0"] + d["x1"]) / 2 + 1, d["y0"] + 1, d["x1"], d["y1"] + 1) for d in GRID[:4]] + GRID[4:] * 2
    assert found(spark, [block(CELLS)], pieces, False) == [whole]
    # filled cells, without a line
    tiles = [rect(50 + 100 * c, 100 + 20 * r, 150 + 100 * c, 120 + 20 * r) for r in range(3) for c in range(3)]
    assert found(spark, [block(CELLS)], tiles, False) == [whole]


def test_cells_of_several_faces(spark):
    spans = [span("across two", 60, 105), span("corner", 260, 105), span("down", 60, 125), span("two", 60, 145), *[span(t, x, y) for t, x, y in (("a", 160, 125), ("b", 260, 125), ("c", 160, 145), ("d", 260, 145))]]
    drawn = [level(100, 50, 350), level(120, 50, 350), level(140, 150, 350), level(160, 50, 350), upright(50, 100, 160), upright(150, 120, 160), upright(250, 100, 160), upright(350, 100, 160)]
    assert found(spark, [block(spans)], drawn, False) == [[["across two", None, "corner"], ["down\ntwo", "a", "b"], [None, "c", "d"]]]


def test_two_grids_and_a_box(spark):
    second = [rect(d["x0"], d["y0"] + 200, d["x1"], d["y1"] + 200) for d in GRID]
    later = [span(s["text"].upper(), s["bbox"][0], s["bbox"][1] + 200) for s in CELLS]
    box = [level(500, 50, 350), level(560, 50, 350), upright(50, 500, 560), upright(350, 500, 560)]
    got = found(spark, [block(later), block(CELLS)], second + box + GRID, False)
    assert [t[0][0] for t in got] == ["r0c0", "R0C0"]


@pytest.mark.parametrize("rows,ruled,expected", [(3, True, 1), (2, True, 1), (3, False, 1), (2, False, 0)])
def test_aligned_rows(spark, rows, ruled, expected):
    spans = [span(f"v{r}{c}", 60 + 100 * c, 105 + 20 * r) for r in range(rows) for c in range(3)]
    drawn = [level(100, 50, 350), level(105 + 20 * rows, 50, 350)] if ruled else []
    got = found(spark, [block(spans)], drawn)
    assert got == [[[f"v{r}{c}" for c in range(3)] for r in range(rows)]] * expected
    assert found(spark, [block(spans)], drawn, False) == []


def test_wrapped_cells_and_gaps_in_aligned_tables(spark):
    spans = [span("name", 60, 100), span("what it does", 200, 100), span("a", 60, 115), span("first line of it", 200, 115), span("and the second", 200, 130), span("b", 60, 145), span("another", 200, 145), span("c", 60, 160), span("last", 200, 160)]
    apart = [span("x", 60, 400), span("y", 200, 400)]
    got = found(spark, [block(spans + apart)], [])
    assert got == [[["name", "what it does"], ["a", "first line of it"], ["", "and the second"], ["b", "another"], ["c", "last"]]]


def test_what_is_no_table(spark):
    prose = [span("This is one line of a column of prose, which goes on", x, 100 + 14 * k, 240) for x in (50, 310) for k in range(6)]
    assert found(spark, [block(prose)], []) == []
    assert found(spark, [block(CELLS)], GRID, given=[]) == []
    assert found(spark, None, None) == [] and found(spark, [], []) == [] and found(spark, [block([span(None, 5, 5), span(" ", 50, 5)])], GRID[:1]) == []


def test_extraction_finds_tables(spark):
    text = block([span("A sentence before the table.", 50, 80)])
    page = (1, 1, 600.0, 800.0, [text, block(CELLS)], GRID, [], None, [])
    blocks = pages.extract(spark.createDataFrame([page], RAW_PAGE)).first().blocks
    assert [b.type for b in blocks] == ["p", "table"] and blocks[1].rows[2] == ["r2c0", "r2c1", "r2c2"]


def slow_components(x0, y0, x1, y1, t):
    up = list(range(len(x0)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(x0)):
        for j in range(i):
            if x0[i] - t <= x1[j] and x0[j] <= x1[i] + t and y0[i] - t <= y1[j] and y0[j] <= y1[i] + t:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(x0))]


@pytest.mark.parametrize("seed", range(40))
def test_sweep(seed):
    rng = np.random.default_rng(seed)
    n, span_ = int(rng.integers(1, 80)), int(rng.choice([30, 100, 400]))
    x0, y0 = rng.integers(0, span_, (2, n)).astype(float)
    x1, y1 = x0 + rng.integers(0, rng.choice([2, 20, 100]), n), y0 + rng.integers(0, rng.choice([2, 20, 100]), n)
    assert spatial.components(x0, y0, x1, y1, 3.0).tolist() == slow_components(x0, y0, x1, y1, 3.0)


def test_a_page_of_many_rectangles(spark):
    import time

    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    x, y = rng.random((2, 20_000)) * 20_000
    rects = [rect(a, b, a + 5, b + 5) for a, b in zip(x, y)]
    df = spark.createDataFrame([(rects,), ([],), (None,)], "r array<struct<x0:double,y0:double,x1:double,y1:double>>")
    got = df.select(F.size(spatial.merge_touching(F.col("r"))).alias("n")).collect()
    assert 10_000 < got[0].n <= 20_000 and [r.n for r in got[1:]] == [0, 0]
    began = time.process_time()
    spatial.components(x, y, x + 5, y + 5, 3.0)
    assert time.process_time() - began < 3
