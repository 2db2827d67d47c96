"""Findings of round 3: queries on small tables that show each fault, against their SQL."""

import duckdb
import pytest

from pagewright.plans import registry
from tests.test_queries import rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def agrees(spark, tmp_path):
    """Does a query over tables (name: rows, ddl) give what its SQL gives? Its rows, if so."""

    def run(name, **tables):
        duck = duckdb.connect()
        for t, (data, ddl) in tables.items():
            spark.createDataFrame(data, ddl).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
            duck.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
        df = registry.queries()[name](spark, str(tmp_path))
        sql = duck.sql(registry.oracle_sql()[name])
        got, want = rows(df.columns, df.collect()), rows(sql.columns, sql.fetchall())
        assert got == want
        return got

    return run


def docs(*texts):
    return [(i, t, "en", "web", 0) for i, t in enumerate(texts, 1)], DOCS


def test_phrases_lose_blanks_not_digits(agrees):
    """sentence 1 was stripped of ones instead of blanks, and so on."""
    bench = [(7, "First one. 1 cat and 1 dog sat on 1! 2 more.  No")], "item_id long, text string"
    got = agrees("q_phrases", documents=docs("(1 cat and 1 dog sat on 1!) No", "x 2 more.y2 more.", "First one.", None), benchmark=bench)
    assert len(got) == 4


def test_cut_references_stay_as_they_are(agrees):
    """`&amp` without its semicolon was read as `&`."""
    html = "<!DOCTYPE html><html><head><title>t</title></head><body><h1>cut &amp</h1><p>whole &amp; sound &amp;lt; &copy; & &am</p></body></html>"
    got = agrees("q_html_blocks_direct", pages=([(1, "http://x/", html), (2, "http://y/", None)], "page_id long, url string, html string"))
    assert [r[-2] for r in got] == ["cut &amp", "whole & sound &lt; © & &am"]


def test_numbers_long_against_letters(agrees):
    """a detected line of more digits than letters is a paragraph like the others."""
    got = agrees("q_ocr_callouts", documents=docs("\n".join(["n"] * 112)))
    assert any("p:x105 n" in r[0] for r in got)


@pytest.mark.parametrize("name", ["documents", "pages", "part"])
def test_a_row_group_is_work_for_many_tasks(spark, name):
    """F10, F15 and all that read documents: a file of one row group was one task's work."""
    from pyspark.sql import functions as F

    from pagewright.plans.inputs import KEYS, table
    from tests.conftest import DATA_01

    d = table(spark, DATA_01, name)
    counts = [r[1] for r in d.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == spark.read.parquet(f"{DATA_01}/{name}.parquet").count()
    assert max(counts) < sum(counts) / 8
    by_key = d.groupBy(KEYS[name], F.lit(1)).count()._jdf.queryExecution().executedPlan().toString()
    assert by_key.count("Exchange") == 1, "what groups by the key shuffles nothing more"


def test_a_table_is_made_once():
    """a table's rows and the columns in use were made anew for each row and cell."""
    from pyspark.sql import functions as F

    from pagewright.operators import tables

    assert str(tables.drop_empty_columns(F.col("zz"))).count("zz") == 1
    assert str(tables.clean_table(F.col("zz"))).count("zz") == 1


def first_fit(boxes):
    """Rows of (y0, y1, i), by their centres, each into the first row whose height it shares by half."""
    rows = []
    for y0, y1, i in sorted(boxes, key=lambda b: ((b[0] + b[1]) / 2, b[2])):
        for r in rows:
            both, union = min(r[1], y1) - max(r[0], y0), max(r[1], y1) - min(r[0], y0)
            if both > 0 and both / union >= 0.5:
                r[0], r[1] = min(r[0], y0), max(r[1], y1)
                r[2].append(i)
                break
        else:
            rows.append([y0, y1, [i]])
    return [r[2] for r in rows]


def grouped(spark, pages):
    from pyspark.sql import functions as F

    from pagewright.operators import ocr
    from pagewright.schema import BOX

    data = [(n, [(0.0, 9.0, float(a), float(b), str(i)) for a, b, i in own]) for n, own in enumerate(pages)]
    d = spark.createDataFrame(data, f"n int, boxes array<{BOX}>").select("n", ocr.group_rows(F.col("boxes")).alias("r"))
    return [[[int(b.text) for b in row.boxes] for row in r.r] for r in d.orderBy("n").collect()]


def test_rows_are_first_fits(spark):
    import random

    rng = random.Random(3)
    box = lambda i, y: (y, y + rng.choice((0, 5, 10, 20, 60, 119)), i)
    pages = [[box(i, rng.randint(0, 120)) for i in range(rng.randint(1, 30))] for _ in range(200)]
    assert grouped(spark, pages) == [first_fit(p) for p in pages]


def test_rows_of_a_long_page(spark):
    """each box was held against all rows of the page."""
    import time

    pages = [[(20 * i, 20 * i + 15, i) for i in range(16_000)]]
    began = time.time()
    assert grouped(spark, pages) == [[[i] for i in range(16_000)]]
    assert time.time() - began < 40


def test_a_page_takes_its_own_words(spark, tmp_path):
    """all words of a document went along with each of its pages."""
    from pagewright.plans import layout_queries

    data, ddl = docs(" ".join(f"w{i}" for i in range(125)))
    spark.createDataFrame(data, ddl).write.parquet(f"{tmp_path}/documents.parquet")
    d = layout_queries._words(spark, str(tmp_path))
    assert [[b.text for b in r.boxes] for r in d.orderBy("page").collect()] == [[f"w{i}" for i in range(a, min(a + 60, 125))] for a in (0, 60, 120)]
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    generate = next(x for x in plan.splitlines() if "Generate posexplode" in x)
    assert "false, [page" in generate and plan.count("slice(") == 0
