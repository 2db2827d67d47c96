"""Findings of round 3 about growth, later: texts gone through fewer times, pages cut within a document's row."""

import re

from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import audit, render
from pagewright.plans import inputs, registry
from pagewright.schema import RUN
from tests.conftest import DATA


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pages_are_cut_where_they_are(spark):
    """lines as rows were sorted and collected by page."""
    assert "Aggregate" not in optimised(inputs.fragments(spark, DATA))
    assert optimised(registry.queries()["q_document_txt"](spark, DATA)).count("Aggregate [") == 1
    assert "Aggregate [" not in optimised(registry.queries()["q_audit_top"](spark, DATA))


def test_pages_are_the_lines(spark):
    rows = inputs.paged(spark, DATA).select("doc_id", "page_number", F.explode("lines").alias("x")).select("doc_id", "page_number", "x.*")
    order = ["doc_id", "line_no"]
    assert rows.orderBy(*order).collect() == inputs.injected(spark, DATA).select(*rows.columns).orderBy(*order).collect()


def test_texts_are_searched_once():
    """each character was looked behind, or tried for both ends."""
    assert T.HYPHEN_WRAP.startswith("(?U)-")
    assert "regexp" not in str(T.strip(F.col("t"))) and "RLIKE" not in str(T.blank(F.col("t")))


def test_short_ways_change_nothing(spark):
    """White space, tokens and joined words by their plain patterns, over all characters."""
    odd = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000] + ["\U0001d400", "\U0001f600"]
    d = spark.createDataFrame([(f"{c}a{c}-{c}b1{c}",) for c in odd] + [("a- b- c -d e-\n f",), ("",), (None,)], "t string")
    plain = d.select(
        "t", F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("strip"), (~F.coalesce("t", F.lit("")).rlike(r"(?U)\S")).alias("blank"), F.regexp_replace("t", r"(?U)\s+$", "").alias("rstrip"),
        F.transform(F.regexp_extract_all(F.coalesce("t", F.lit("")), F.lit(r"(?U)[^\W\d_]+|\d+"), F.lit(0)), F.lower).alias("tokens"),
        F.regexp_replace(F.regexp_replace(F.coalesce("t", F.lit("")), r"[\x{E000}-\x{F8FF}]|[\x00-\x08\x0B-\x1F]", ""), r"(?U)(?<=[A-Za-zА-Яа-яЁё])-\s+(?=[A-Za-zА-Яа-яЁё])", "").alias("clean"),
    )
    t = F.col("t")
    own = d.select("t", T.strip(t).alias("strip"), T.blank(t).alias("blank"), T.rstrip(t).alias("rstrip"), T.tokens(t).alias("tokens"), T.clean(t, False).alias("clean"))
    assert own.collect() == plain.collect()


def test_source_is_read_once(spark):
    """F16: sound and garbled pages were made, and told apart, in a pass each."""
    assert optimised(registry.queries()["q_source_tokens"](spark, DATA)).count("Relation [") == 1


def test_nested_elements_keep_their_type():
    """F16: elements that can't be null came back as such that can."""
    import pyarrow as pa

    from pagewright.functions.normalise import fold

    kind = pa.list_(pa.field("element", pa.struct([pa.field("l", pa.list_(pa.field("element", pa.struct([pa.field("t", pa.string())]), nullable=False)))]), nullable=False))
    got = fold(pa.array([[{"l": [{"t": "\N{LATIN SMALL LIGATURE FI}"}]}], []], kind))
    assert got.type == kind and got.to_pylist() == [[{"l": [{"t": "fi"}]}], []]
