import re

import duckdb
from pyspark.sql import functions as F

from pagewright.llm import quality_rules as Q
from tests.conftest import DATA_01


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, at = {}, set()
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            at.update(j for i in places for j in range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(at)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_documents_and_sql(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA_01}/documents.parquet").collect()}
    got = {r.doc_id: r for r in Q.op3_quality_rules(spark, DATA_01).collect()}
    for d, t in text.items():
        assert tuple(got[d][n] for n in NAMES) == brute(t), d
    duckdb.sql(f"create or replace view documents as select * from '{DATA_01}/documents.parquet'")
    sql = duckdb.sql(Q.ORACLE)
    assert {r[0]: r[1:] for r in sql.fetchall()} == {d: tuple(r)[1:] for d, r in got.items()}
    assert sql.columns == list(next(iter(got.values())).asDict())
    good = {r[0] for r in duckdb.sql(f"select doc_id from '{DATA_01}/labels.parquet' where quality = 1").fetchall()}
    assert sum(got[d].kept for d in good if d in got) > 0.97 * len(good)


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "w " * 9, None), (4, "a b c d e a b c d e x y z", "a"), (5, "a a a a a a a", "a"), (6, "l 1\nl 1\n \n\nl 1", "b"), (6, "l 1\nl 1\n \n\nl 1", "b")]
    rows += [(7, " ".join(f"w{i % 7000}" for i in range(20_000)), "c"), (8, "é\x0bß\x1c x", "d")]
    d = spark.createDataFrame([(i, t, s, 1, "q") for i, t, s in rows], "doc_id long, text string, source string, words int, host string")
    got = Q.apply_rules(d).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, _ in rows}
    for r in got:
        assert tuple(r[n] for n in NAMES) == brute(text[r.doc_id]), r.doc_id
    assert Q.apply_rules(d.where("false")).collect() == []


def test_hosts(spark):
    hosts = spark.createDataFrame([("good", 1000, 1), ("mid", 1000, 300), ("bad", 1000, 995), ("tiny", 1, 1)], "host string, n long, failed long")
    v = {r.host: r for r in Q.host_verdicts(hosts).collect()}
    assert v["good"].trusted and not v["good"].bad and not v["mid"].trusted and not v["mid"].bad
    assert v["bad"].bad and not v["tiny"].bad and 0.4 < v["tiny"].rate < 1
    good = " ".join(f"word{i}" for i in range(30))
    junk = " ".join(f"{i}###" for i in range(30))
    rows = [(i, junk if h == "bad" and i % 100 else good, h) for h in ("bad", "fine") for i in range(400)]
    d = spark.createDataFrame([(i, t, h) for i, (_, t, h) in enumerate(rows)], "doc_id long, text string, source string")
    kept = {(r.host, len(r.failed_rules) > 0): r.kept for r in Q.apply_rules(d).collect()}
    assert kept == {("bad", True): False, ("bad", False): False, ("fine", False): True}


def test_null_and_empty_hosts(spark):
    """A null host and the empty one are judged apart, in Spark and in SQL."""
    good, junk = " ".join(f"word{i}" for i in range(30)), " ".join(f"{i}###" for i in range(30))
    rows = [(i, junk if i % 50 else good, None) for i in range(300)] + [(1000 + i, good if i else junk, "") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in Q.apply_rules(d).collect()}
    assert len(got) == 600
    nulls, empties = {got[i].host_rate for i in range(300)}, {got[1000 + i].host_rate for i in range(300)}
    assert len(nulls) == len(empties) == 1 and nulls.pop() > 0.9 and empties.pop() < 0.1
    assert {got[i].host for i in range(300)} == {None} and not got[0].kept and got[1001].kept
    con = duckdb.connect()
    frame = d.toPandas()
    con.register("documents", frame)
    assert {r[0]: r[-1] for r in con.sql(Q.ORACLE).fetchall()} == {i: r.kept for i, r in got.items()}
