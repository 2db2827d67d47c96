from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from pagewright.llm import _common as C


def test_stash_and_release(spark):
    d = C.stash(spark.range(10))
    where = Path(d._pagewright_table.removeprefix("file://"))
    assert d.count() == 10 and where.exists()
    C.release(d, spark.range(3), None)
    assert not where.exists()


def test_a_cluster_needs_a_shared_folder():
    conf = lambda found: SimpleNamespace(get=lambda _: found)
    session = lambda master, found: SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf(found), master=master))
    with pytest.raises(RuntimeError):
        C.shared_dir(session("spark://host:7077", None))
    assert C.shared_dir(session("spark://host:7077", "hdfs://a/b/")) == "hdfs://a/b"
    assert C.shared_dir(session("local[2]", None)).startswith("file://")


def test_join_hot(spark, monkeypatch):
    """As a plain join, inner or left, with hot keys, null keys, keys on one side alone, and none hot at all."""
    rows = spark.range(3000).select(F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).cast("long").alias("k"), F.col("id").alias("x"))
    keys = rows.where("k is not null and k % 5 <> 4").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2)
    for parts in (10, 1):
        monkeypatch.setattr(C, "HOT_PARTS", parts)
        for how in ("inner", "left"):
            got = C.join_hot(C.stash(rows), C.stash(keys), "k", how=how).select("k", "x", "n", "v").collect()
            want = rows.join(keys, "k", how).select("k", "x", "n", "v").collect()
            assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
