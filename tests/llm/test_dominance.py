import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import dominance as D
from tests.conftest import DATA_01

SCHEMA = "id long, slot long, level long, weight long"


def brute(points):
    out = []
    for i, s, v, _ in points:
        above = [w for _, t, u, w in points if None not in (s, v, t, u) and t < s and u > v]
        out.append((i, s, v, None, None) if s is None or v is None else (i, s, v, len(above), sum(w or 0 for w in above)))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_against_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"create view sales as select * from '{DATA_01}/sales.parquet'")
    want = sorted(duck.sql(D.ORACLE).fetchall(), key=repr)
    assert result(D.op12_dominance_counting(spark, DATA_01)) == want
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert result(D.op12_dominance_counting(spark, DATA_01)) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("shards", [1, 2, 5, 64])
@pytest.mark.parametrize("kind", ["even", "one slot", "one level", "one cell", "few", "wide"])
def test_against_brute_force(spark, kind, shards):
    rng = np.random.default_rng(3)
    n = 400
    slot, level = rng.integers(-20, 20, n), rng.integers(-30, 30, n)
    hot = rng.random(n) < 0.5
    if kind in ("one slot", "one cell"):
        slot[hot] = 4
    if kind in ("one level", "one cell"):
        level[hot] = 4
    if kind == "few":
        slot, level = slot % 2, level % 2
    if kind == "wide":
        slot, level = rng.integers(-(1 << 62), 1 << 62, n), rng.permutation(n)
    points = [(int(i % 300), int(s), int(v), int(i % 4)) for i, (s, v) in enumerate(zip(slot, level))]
    points += [(None, None, 3, 1), (1, 2, None, 1), (2, None, None, None), (None, 0, 0, None), (None, 0, 0, None)]
    df = spark.createDataFrame([(*p, "x") for p in points], f"{SCHEMA}, n_above string")
    assert result(D.count_above(df, shards)) == brute(points)


def test_empty_table(spark):
    assert D.count_above(spark.createDataFrame([], SCHEMA)).collect() == []


def test_extreme_values(spark):
    points = [(i, s, v, 1) for i, (s, v) in enumerate((a, b) for a in (D.LEAST, 0, D.MOST) for b in (D.LEAST, 0, D.MOST))] * 3
    assert result(D.count_above(spark.createDataFrame(points, SCHEMA))) == brute(points)


def test_broken_totals_and_ids(spark):
    rows = [(None, 15.0, "2024-01-02 00:00:00"), (1, float("nan"), "2024-01-01 00:00:00"), (2, float("inf"), "2024-01-01 00:00:00"), (3, -0.004, "1969-12-31 23:59:59"), (4, 999.995, "2024-01-01 23:59:59.9")]
    sales = spark.createDataFrame(rows, "sale_id long, total double, at string").withColumn("sold_at", F.col("at").cast("timestamp_ntz"))
    got = {r.id: (r.slot, r.level, r.weight) for r in D.sales_points(sales).collect()}
    assert got[None] == (19724, 1, 1) and got[1][1] is None and got[2][1] is None
    assert got[3] == (-1, 0, 1 + zlib.crc32(b"3") % 3) and got[4] == (19723, 100, 1 + zlib.crc32(b"4") % 3)


def test_runs_grow_geometrically():
    rng, runs, seen = np.random.default_rng(1), D.Runs(), []
    for step in range(300):
        levels = rng.integers(0, 50, rng.integers(1, 4))
        q = rng.integers(-1, 51, 5)
        want = [[sum(w[k] for v, w in seen if v > x) for x in q] for k in (0, 1)]
        assert runs.above(q).tolist() == want
        weights = rng.integers(0, 9, (2, len(levels)))
        runs.add(levels, weights)
        seen += list(zip(levels, weights.T.tolist()))
    sizes = [len(r[0]) for r in runs.runs]
    assert all(a > b for a, b in zip(sizes, sizes[1:])) and len(sizes) < 12


def test_stream_goes_on_across_batches():
    import pyarrow as pa

    rng = np.random.default_rng(7)
    rows = sorted((int(p), int(a), int(v)) for p, a, v in zip(rng.integers(0, 3, 200), rng.integers(0, 6, 200), rng.permutation(200)))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([False] * 200), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]), pa.array([1] * 200), pa.array([2] * 200), pa.array([0] * 200)],
        ["part", "at", "seed", "slot", "level", "n", "w", "held"],
    )
    whole = pa.Table.from_batches(D._stream(iter([batch]))).to_pylist()
    for size in (1, 7, 60):
        cut = [batch.slice(i, size) for i in range(0, 200, size)]
        assert pa.Table.from_batches(D._stream(iter(cut))).to_pylist() == whole
    assert [r["n_above"] for r in whole] == [sum(q[0] == p[0] and q[1] < p[1] and q[2] > p[2] for q in rows) for p in rows]
