"""Findings of round 4: a store that lost something, and rows of detections in proportion to their number."""

import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.operators import ocr
from pagewright.plans import registry
from pagewright.schema import BOX, FRAGMENT
from pagewright.streaming.store import Store
from tests.conftest import DATA
from tests.test_findings_r03 import first_fit

DAMAGE = {
    "torn": lambda f: f.write_bytes(b"PAR1" + bytes(f.stat().st_size - 4)),
    "cut": lambda f: f.write_bytes(f.read_bytes()[:-9]),
    "emptied": lambda f: f.write_bytes(b""),
    "gone": lambda f: f.unlink(),
}


def damaged(path, damage):
    """Damages one file of rows below path, and what its file system keeps to check it by."""
    file = sorted(Path(path).rglob("*.parquet"))[0]
    file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    DAMAGE[damage](file)


@pytest.mark.parametrize("damage", DAMAGE)
def test_a_store_that_lost_rows_is_not_read(spark, tmp_path, damage):
    """what couldn't be read counted as absent, and the rest was given out as the whole."""
    store = Store(spark, str(tmp_path / "s"))
    store.append(spark.createDataFrame([(d, 1, ["a"], [], []) for d in range(50)], FRAGMENT), "one")
    assert store.read().count() == 50
    damaged(tmp_path / "s", damage)
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", "true")
    try:
        for read in (store.read, lambda: store.batch(store.batches()[0]), lambda: store.read(spark.range(50).toDF("doc_id"))):
            with pytest.raises(Exception, match="as it was published|CANNOT_READ|not a Parquet file"):
                read().collect()
    finally:
        spark.conf.unset("spark.sql.files.ignoreCorruptFiles")


def test_an_entry_of_old_is_read(spark, tmp_path):
    """Entries of batches that were published before they told of their files."""
    store = Store(spark, str(tmp_path / "s"))
    for name in ("one", "two"):
        store.append(spark.createDataFrame([(1, 1, [name], [], [])], FRAGMENT), name)
    for entry in (tmp_path / "s" / "_log").glob("0*"):
        entry.with_name(f".{entry.name}.crc").unlink(missing_ok=True)
        entry.write_text('{"replaces": []}')
    assert [r.margin for r in store.read().collect()] == [["two"]]


@pytest.mark.parametrize(("name", "damage"), [("q_growing_documents", "torn"), ("q_growing_documents", "gone"), ("q_stream", "torn"), ("q_stream", "emptied")])
def test_a_query_of_a_damaged_store_fails(spark, monkeypatch, name, damage):
    """the query gave its rows without those of the file."""
    own = Store.publish

    def publish(self, batch, replaces=()):
        own(self, batch, replaces)
        damaged(f"{self.path.removeprefix('file:').replace('//', '/')}/batches/batch={batch}", damage)

    monkeypatch.setattr(Store, "publish", publish)
    with pytest.raises(Exception, match="as it was published|CANNOT_READ|not a Parquet file"):
        registry.queries()[name](spark, DATA).collect()


def test_a_broken_line_stops_the_stream(spark, tmp_path):
    """a page of a torn file was left out for good, as its file counted as taken."""
    from pagewright.streaming import incremental
    from tests.test_store import plain, put, raw

    store = Store(spark, str(tmp_path / "s"))

    def run():
        incremental.stream_fragments(spark, str(tmp_path / "in"), store, str(tmp_path / "check"), extract=plain).awaitTermination()

    put(spark, tmp_path / "in", raw(1, 1, "one"))
    whole = (tmp_path / "in" / "late.json", '{"doc_id":2,"page_number":1,"blocks":[]}\n')
    whole[0].write_text(whole[1][:-9])
    with pytest.raises(Exception, match="(?i)malformed"):
        run()
    assert store.batches() == []
    whole[0].write_text(whole[1])
    run()
    assert sorted(r.doc_id for r in store.read().collect()) == [1, 2]


def boxed(*pages):
    from pagewright.operators import row_folds

    return pa.array([[dict(zip(("x0", "x1", "y0", "y1", "text"), b, strict=True)) for b in p] for p in pages], pa.list_(row_folds.BOX))


@pytest.mark.parametrize("name", ["q_rows", "q_reflow"])
def test_no_fold_goes_box_by_box(spark, name):
    """rows and paragraphs were folded by expressions, evaluated anew for each box of each page."""
    plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "CASE WHEN" not in plan


def test_long_and_crowded_pages():
    """a page of 100000 rows, and one of 3000 rows of which none ends before the next begins, beside 20000 of a box each."""
    from pagewright.operators import row_folds

    long = [(0.0, 9.0, 20.0 * i, 20.0 * i + 15, str(i)) for i in range(100_000)]
    crowd = [(0.0, 9.0, 1e6 - 3.0**k, 1e6 + 3.0**k, str(k)) for k in (n / 100 for n in range(0, 1200, 100))] + [(0.0, 9.0, float(i), 1e7 * 4.0 ** (i % 60), "x") for i in range(60)]
    pages = boxed(*([[(0.0, 9.0, 0.0, 5.0, "a")]] * 20_000), long, crowd, [])
    began = time.time()
    got = row_folds.group_rows(pages)
    assert time.time() - began < 40
    assert [len(p) for p in got[:20_000]] == [1] * 20_000 and len(got[20_000]) == 100_000 and len(got[20_002]) == 0
    order = sorted(range(len(crowd)), key=lambda i: (crowd[i][2] + crowd[i][3]) / 2)
    want = first_fit([(crowd[i][2], crowd[i][3], i) for i in order])
    assert [[b["text"].as_py() for b in r["boxes"]] for r in got[20_001]] == [[crowd[i][4] for i in r] for r in want]


def test_parts_of_a_batch_are_its_whole(monkeypatch):
    from pagewright.operators import row_folds

    rng = np.random.default_rng(3)
    pages = [[(x, x + 40.0, y, y + 20.0, f"w{i}") for i, (x, y) in enumerate(rng.integers(0, 300, (n, 2)).astype(float).tolist())] for n in (0, 9, 30, 1, 0, 17, 0)]
    lists = boxed(*pages)
    whole = [f(lists).to_pylist() for f in (row_folds.group_rows, row_folds.rows, row_folds.paragraphs)]
    monkeypatch.setattr(row_folds, "PART", 10)
    monkeypatch.setattr(row_folds, "PLACES", 20)
    assert [f(lists).to_pylist() for f in (row_folds.group_rows, row_folds.rows, row_folds.paragraphs)] == whole
    assert row_folds.rows(lists[:0]).to_pylist() == [] and row_folds.paragraphs(lists[2:4]).to_pylist() == whole[2][2:4]
    assert row_folds.of_each(row_folds.paragraphs)(pa.array([lists.to_pylist()[:3], None, [], lists.to_pylist()[3:]], pa.list_(lists.type))).to_pylist() == [whole[2][:3], None, [], whole[2][3:]]


def test_rows_are_split_as_before(spark):
    """Gaps, gutters, a page number on the right, blank texts, sides and texts that aren't there."""
    row = lambda *boxes: [(float(x), float(x + 50), 0.0, 20.0, t) for x, t in boxes]
    cases = [
        (row((0, "a"), (60, "b"), (400, "c"), (460, "d")), None, ["a b", "c d"]),
        (row((0, "a"), (60, "b"), (400, " 12. ")), None, ["a b  12. "]),
        (row((0, "a"), (60, "b"), (400, "12"), (460, " ")), None, ["a b 12"]),
        (row((0, "a"), (60, "b"), (400, "12"), (460, "x")), None, ["a b", "12 x"]),
        (row((0, "a"), (200, "b"), (400, "c"), (600, "d")), None, ["a b c d"]),
        (row((0, "a"), (60, "b"), (130, "c")), (115.0, 125.0), ["a b", "c"]),
        (row((0, "a"), (600, "b"), (900, "c"), (960, "d")), None, ["a b c d"]),
        (row((0, "a"), (900, "b"), (1060, "c"), (1110, "d"), (1160, "e")), None, ["a", "b", "c d e"]),
        ([(None, None, None, None, "n"), (0.0, 9.0, 0.0, 20.0, None), (9.0, 20.0, 0.0, 20.0, "\u3000")], None, ["n"]),
        (None, None, None),
    ]
    d = spark.createDataFrame([(n, b, g) for n, (b, g, _) in enumerate(cases)], f"n int, boxes array<{BOX}>, g struct<left:double,right:double>")
    got = d.select("n", ocr.rows(F.col("boxes"), F.col("g")).alias("r")).orderBy("n").collect()
    assert [r.r if r.r is None else [b.text for b in r.r] for r in got] == [want for *_, want in cases]


def test_paragraphs_are_joined_as_before(spark):
    """Ends, list items, numbers at the end, headings that go on, and white space that isn't ASCII."""
    rows = lambda *texts: [(0.0, 9.0, 25.0 * i, 25.0 * i + h, t) for i, (t, h) in enumerate(x if isinstance(x, tuple) else (x, 20) for x in texts)]
    cases = [
        (rows("one\u3000", "two", "three.", "four"), [("one two three.", None), ("four", None)]),
        (rows("one", "12", "three"), [("one 12", None), ("three", None)]),
        (rows("12", "three"), [("12 three", None)]),
        (rows("one", "1. two", "\u2022 three", "1.four", "99 five", "1. six\nseven"), [("one", None), ("1. two", None), ("\u2022 three 1.four", None), ("99 five 1. six\nseven", None)]),
        (rows(("Head", 34), ("goes on", 34), "plain", "text", "more"), [("Head goes on plain text more", 2)]),
        (rows(("Head", 26), "ends.", "plain", "text", "more", "yet"), [("Head", 3), ("ends.", None), ("plain text more yet", None)]),
        (rows(("2024 12345", 34), "plain", "text"), [("2024 12345 plain text", None)]),
        ([], []),
        (None, None),
    ]
    d = spark.createDataFrame([(n, r) for n, (r, _) in enumerate(cases)], f"n int, r array<{BOX}>")
    got = d.select("n", ocr.paragraphs(F.col("r")).alias("p")).orderBy("n").collect()
    assert [r.p if r.p is None else [(p.text, p.level) for p in r.p] for r in got] == [want for _, want in cases]
