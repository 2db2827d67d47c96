"""Findings of round 3 about growth: work that is done once, in proportion to its input."""

import time

from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import audit, pages, render
from pagewright.plans import inputs, registry
from pagewright.schema import RUN
from tests.conftest import DATA


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_runs_of_a_long_line(spark):
    """all runs joined so far were copied for each further one."""
    n = 60_000
    one = lambda i: F.struct(F.concat(F.lit("w"), i.cast("string")).alias("text"), (F.floor(i / 2) % 2 == 0).alias("bold"), F.lit(False).alias("italic"), F.lit(False).alias("superscript"), F.lit(None).cast("string").alias("href")).cast(RUN)
    d = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one).alias("runs"))
    began = time.time()
    got = d.select(pages.emphasis(F.col("runs")).alias("r")).first().r
    assert time.time() - began < 20
    assert [(r.text, r.bold) for r in got] == [(f"w{i}w{i + 1}", i % 4 == 0) for i in range(0, n, 2)]


def test_runs_are_made_once(spark):
    """what dropped null runs, and asked for their number, made them anew."""
    plan = optimised(registry.queries()["q_runs"](spark, DATA))
    assert sum("exists(" in x for x in plan.splitlines()) == 1


def test_the_heaviest_is_found_in_one_list():
    """spans were gone through, and their texts searched, anew for each font and size."""
    assert str(pages._heaviest(F.col("zz"), "font")).count("zz") == 1
    block = F.struct(F.lit(0).alias("type"), F.col("bb").alias("bbox"), F.col("ll").alias("lines"))
    assert str(pages.dominant_font(block)).count("ll AS lines") == 1


def test_heaviest(spark):
    d = spark.sql("select array(named_struct('font', 'a', 'n', 2), named_struct('font', 'b', 'n', 3), named_struct('font', 'a', 'n', 1), named_struct('font', null, 'n', 9)) as x")
    none = d.select(F.filter("x", lambda x: F.lit(False)).alias("x"))
    assert d.select(pages._heaviest(F.col("x"), "font").alias("r")).first().r[:] == (3, 0, "a")
    assert none.select(pages._heaviest(F.col("x"), "font").alias("r")).first().r is None


def test_spans_stay_arrays(spark):
    """a page's blocks were written as JSON and parsed for each use."""
    assert "json" not in optimised(registry.queries()["q_body_size"](spark, DATA)).lower()


def test_pages_are_extracted_once(spark):
    """what explodes a page's blocks asks for their number, for which they were made a first time."""
    plan = optimised(registry.queries()["q_extract"](spark, DATA))
    assert not [x for x in plan.splitlines() if "Filter" in x and "size(flatten(" in x]


def test_growing_documents_make_no_frames(spark, tmp_path, monkeypatch):
    """a data frame was made, and read, for each document of a batch, and all fragments were made for each batch."""
    from pagewright.plans import stream_queries
    from pagewright.streaming import documents

    asked = []
    monkeypatch.setattr(stream_queries, "fragments", lambda *a: asked.append(a) or inputs.fragments(*a))
    monkeypatch.setattr(documents.Pages, "handleInputRows", lambda *a: 1 / 0)
    got = {(r.doc_id, r.page_number): r.margin for r in stream_queries.q_growing_documents(spark, DATA).collect()}
    want = {(r.doc_id, r.page_number): " · ".join(r.margin_display) for r in render.hide_running_heads(inputs.fragments(spark, DATA)).collect()}
    assert got == want and len(asked) == 1


def test_row_state_begins_with_what_is_stored(spark, tmp_path, monkeypatch):
    """a fresh checkpoint over stored pages, by rows: a later page's head is hidden by a stored one."""
    from pagewright.schema import FRAGMENT
    from pagewright.streaming.documents import PROVIDER, Documents

    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        docs = Documents(spark, str(tmp_path / "d"), "txt")
        for page in (1, 2):
            spark.createDataFrame([(7, page, ["Head", str(page)], [], [])], FRAGMENT).write.parquet(str(tmp_path / f"in{page}"))
            docs.take(spark.readStream.schema(FRAGMENT).parquet(str(tmp_path / f"in{page}")), str(tmp_path / f"check{page}")).awaitTermination()
        assert [(r.page_number, r.margin) for r in docs.references.read().orderBy("page_number").collect()] == [(1, ["Head", "1"]), (2, ["2"])]
    finally:
        spark.conf.set(PROVIDER[0], before)


def test_list_items_of_a_long_block(spark):
    """what an item had so far was copied for each of its lines, though a block without marks has no items."""
    n = 40_000
    line = lambda i: F.concat(F.when(i % 20_000 == 3, "1. ").otherwise(""), F.lit("a line of a rather long block, of which there are many more "), i.cast("string"))
    d = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), line).alias("l"))
    began = time.time()
    plain, got = d.select(pages.list_items(F.slice("l", 5, 9_000)), pages.list_items(F.col("l"))).first()
    assert time.time() - began < 12
    assert plain is None and [x.ordered for x in got] == [None, True, True]
    assert got[0].text == " ".join(f"a line of a rather long block, of which there are many more {i}" for i in range(3))
    assert got[2].text.count("a line") == 19_997 and got[2].text.endswith(" 39999") and got[2].text.startswith("a line")


def test_batches_are_worked_on_in_parts():
    """A batch of pages was normalised, and its tokens were compared, all at once."""
    import pyarrow as pa

    from pagewright.functions import normalise
    from pagewright.operators import audit

    texts = [None if i % 7 == 0 else [f"\N{LATIN SMALL LIGATURE FI}{i}" * 40_000, None, "a"] for i in range(60)]
    batch = pa.RecordBatch.from_pydict({"n": list(range(60)), "t": pa.array(texts, pa.list_(pa.string())), "same": pa.array(texts, pa.list_(pa.string()))})
    parts = list(normalise.folded(iter([batch]), ["t"]))
    assert len(parts) > 2 and max(p.num_rows for p in parts) < 30
    whole = pa.Table.from_batches(parts).to_pydict()
    assert whole["n"] == list(range(60)) and whole["same"] == texts
    assert whole["t"] == [t and [x and x.replace("\N{LATIN SMALL LIGATURE FI}", "fi") for x in t] for t in texts]
    assert audit.STEP <= 100_000


def test_pages_are_audited_in_their_rows(spark):
    """documents were read and cut into pages for each side, to be joined again, and a pair for each token came back unused."""
    plan = optimised(registry.queries()["q_audit_top"](spark, DATA))
    assert plan.count("Relation [") == 1 and "Join" not in plan and "matches#" not in plan
    f = inputs.fragments(spark, DATA, T.tokens(F.array_join(F.transform("lines", lambda x: x["text"]), " ")).alias("tokens"))
    order = ["doc_id", "page_number"]
    own, joined = audit.audit_rows(f), audit.audit(f.select(*order, "tokens"), f.drop("tokens"))
    assert own.columns == joined.columns and own.orderBy(*order).collect() == joined.orderBy(*order).collect()
