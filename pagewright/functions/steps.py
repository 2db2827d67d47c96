"""Columns made once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folds within folds resolve a level at a time; the analyser's usual 100 rounds don't do for whole pages.
ROUNDS = "spark.sql.analyzer.maxIterations"


@contextmanager
def deep_folds(spark: SparkSession, rounds: int = 1000) -> Iterator[None]:
    """Let the analyser take so many rounds while a plan is put together; the session's own setting comes back after."""
    before = spark.conf.get(ROUNDS)
    spark.conf.set(ROUNDS, str(max(rounds, int(before))))
    try:
        yield
    finally:
        spark.conf.set(ROUNDS, before)


def bind(value: Column, *steps: Callable[[Column], Column]) -> Column:
    """steps applied one after another, each value made once."""
    bound = F.array(value)
    for step in steps:
        bound = F.transform(bound, step)
    return F.element_at(bound, 1)


def once(d: DataFrame, name: str, value: Column) -> DataFrame:
    """As withColumn, but value is made once for each row, wherever it is used later.

    The optimiser merges projections and would put a column's expression into a lambda that reads
    it, to be made anew for each element; it doesn't merge them across a generator of one row.
    """
    return d.select(*[c for c in d.columns if c != name], F.stack(F.lit(1), value).alias(name))
