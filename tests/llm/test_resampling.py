import hashlib
import math
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from pagewright.llm import resampling as R
from tests.conftest import DATA

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string"


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(rows, target, percent=5, least=20):
    s, t = [0] * 10000, [0] * 10000
    made = [(i, *features(x)) for i, x in rows]
    for _, _, f in made:
        for b in f:
            s[b] += 1
    for x in target:
        for b in features(x)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    out = []
    for i, n, f in made:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[1], r[2]))
    drawn = percent * len(able) // 100
    rank = {id(r): k + 1 for k, r in enumerate(able[:drawn])}
    return sorted((tuple(r[:4]) + (rank.get(id(r)),) for r in out), key=repr)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_against_sql_and_brute_force(spark):
    got = R.op11_target_resampling(spark, DATA)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert result(got) == brute(rows, target)
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    assert sorted(duck.sql(R.ORACLE).fetchall(), key=repr) == result(got)


def test_edges_ties_and_repeated_rows(spark):
    long = "Ärger IM Wort " * 9
    rows = [(1, None), (2, ""), (3, " .,!"), (4, "one"), (5, "Two-Words"), (None, long), (7, "x" * 200_000), (8, "w " * 20_000)]
    rows += [(9, long)] * 30 + [(20 + i, f"{long} tail {i}") for i in range(200)]  # one id and text thirty times
    docs = spark.createDataFrame([(*r, 5, "a") for r in rows], f"{SCHEMA}, score long, rank string")
    target = spark.createDataFrame([("Im Wort",), (None,)], "text string")
    for percent in (5, 13, 100, 0):
        assert result(R.resample(docs, target, percent=percent)) == brute(rows, ["Im Wort", None], percent)


def test_many_ties_at_the_last_drawn_score(spark):
    rows = [(9, "a b c d e f g h i j k l m n o p q r s t u")] * 300
    got = R.resample(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], "text string"), percent=10)
    assert sorted(r.rank for r in got.collect() if r.rank) == list(range(1, 31))
    assert {r.weight for r in got.collect()} == {brute(rows, [])[0][2]}


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b")], SCHEMA)
    assert R.resample(none, some).collect() == []
    assert result(R.resample(some, none)) == brute([(1, "a b")], [])


@pytest.mark.parametrize("values", [[5], [3, 3, 3], [-7, 0, 12, 12, 10**9, -(10**9)], list(range(3000))])
def test_last_drawn(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in {1, len(values), (len(values) + 1) // 2}:
        assert R.last_drawn(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_counts_alone_are_shuffled(spark):
    """What is dealt out to learn the gains is one row a bucket and task, after a sum in each task."""
    docs = spark.createDataFrame([(i, "a b c d e") for i in range(2000)], SCHEMA)
    counts = R.bucketed(docs, ["doc_id"]).select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and plan.count("Exchange") == 1
