"""Dominance counting: for each point, how many others have a smaller slot and a larger level, by the logarithmic method.

Points of equal slot and level are one cell with sums. Cells are cut into shards by slot and into strips by level, at quantiles, so that each
holds about the same number of cells; a slot or level with more cells than that is a shard or strip by itself. What is above a cell falls in three parts:

- in its own shard: the shard's cells stream through a task in the order of their slots. The state is a list of runs, sorted by level, with
  sums of counts from each level up. A slot's cells first search every run by bisection, then become a run of their own; a run is merged with the one
  before as long as that isn't longer, so sizes grow geometrically and a shard of m cells keeps about log m runs.
- in earlier shards but the same strip: the strip's cells stream likewise, in the order of their shards.
- in earlier shards and higher strips: sums of a grid of shards by strips, scanned along both sides. They seed the strips' streams.

A shard or strip of one value has nothing above within it, and its cells need no common task. So no task holds more than its share of cells,
whatever the rows of one slot, level or cell; the driver sees the quantiles alone, whose number is a parameter. What is joined back to points by broadcast
are cells of more than a 4096th of all points, so 4096 at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import join_hot, stash, table
from .resampling import CRC_TABLE, crc_sql

SHARDS = 64
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class Runs:
    """Level-sorted runs of geometric sizes: levels, and sums of n and w from each place on, 0 at the end."""

    def __init__(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def above(self, levels: np.ndarray) -> np.ndarray:
        """Sums (2 x len(levels)) of n and w of what has been added with a level strictly larger."""
        out = np.zeros((2, len(levels)), np.int64)
        for own, sums in self.runs:
            out += sums[:, np.searchsorted(own, levels, "right")]
        return out

    def add(self, levels: np.ndarray, weights: np.ndarray) -> None:
        """Add points with weights (2 x len(levels)): n and w."""
        while self.runs and len(self.runs[-1][0]) <= len(levels):
            own, sums = self.runs.pop()
            levels, weights = np.concatenate((own, levels)), np.concatenate((sums[:, :-1] - sums[:, 1:], weights), axis=1)
        order = np.argsort(levels, kind="stable")
        levels, weights = levels[order], weights[:, order]
        heads = np.flatnonzero(np.concatenate(([True], levels[1:] != levels[:-1])))
        levels, weights = levels[heads], np.add.reduceat(weights, heads, axis=1)
        sums = np.zeros((2, len(levels) + 1), np.int64)
        sums[:, :-1] = weights[:, ::-1].cumsum(axis=1)[:, ::-1]
        self.runs.append((levels, sums))


STREAM = "part long, at long, seed boolean, slot long, level long, n long, w long, held long"
COUNTS = "slot long, level long, n_above long, w_above long, held long"


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """COUNTS of rows STREAM that are sorted by part and at: of each row but seeds, sums over what its part holds at a smaller `at`, of a larger level, and over the seeds of its own `at`."""
    runs, part = Runs(), None
    held: list[np.ndarray] | None = None

    def group(g: list[np.ndarray]) -> pa.RecordBatch:
        nonlocal runs, part
        own_part, _, seed, slot, level, n, w, keep = g
        if own_part[0] != part:
            runs, part = Runs(), own_part[0]
        rows = ~seed
        base = np.array([n[seed].sum(), w[seed].sum()])
        found = runs.above(level[rows]) + base[:, None]
        if rows.any():
            runs.add(level[rows], np.stack((n[rows], w[rows])))
        out = (slot[rows], level[rows], found[0], found[1], keep[rows])
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["slot", "level", "n_above", "w_above", "held"])

    for batch in batches:
        own = [c.fill_null(0 if c.type != pa.bool_() else False).to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            own = [np.concatenate(x) for x in zip(held, own, strict=True)]
        if not len(own[0]):
            continue
        new = np.flatnonzero((own[0][1:] != own[0][:-1]) | (own[1][1:] != own[1][:-1])) + 1
        ends = [0, *new.tolist()]
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield group([x[a:b] for x in own])
        held = [x[ends[-1] :] for x in own]
    if held is not None:
        yield group(held)


def quantiles(cells: DataFrame, column: str, shards: int) -> list[int]:
    """Lower ends of all parts but the first: part p holds values from its lower end to the next. A value that is several quantiles is a part by itself."""
    found = cells.agg(F.percentile_approx(column, [k / shards for k in range(1, shards)], 10_000)).first()[0] or []
    often = {a for a, b in zip(found[:-1], found[1:], strict=True) if a == b and a < MOST} if found else set()
    return sorted(set(found) | {v + 1 for v in often})


def place(x: Column, bounds: list[int], first: int = 0) -> Column:
    """How many of the bounds are not above x, by bisection in one expression."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(x < bounds[mid], place(x, bounds[:mid], first)).otherwise(place(x, bounds[mid + 1 :], first + mid + 1))


def alone(part: Column, bounds: list[int]) -> Column:
    """Whether a part is of one value."""
    return part.isin([p + 1 for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b == a + 1] or [-1])


def _grid(cells: DataFrame, n_shards: int, n_strips: int) -> DataFrame:
    """(shard, strip, n, w) of pairs that hold cells: sums over all earlier shards and higher strips. The grid's size is a parameter."""
    own = cells.groupBy("shard", "strip").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    all_ = cells.sparkSession.range(n_shards * n_strips).select(F.floor(F.col("id") / n_strips).cast("int").alias("shard"), (F.col("id") % n_strips).cast("int").alias("strip"))
    full = all_.join(own, ["shard", "strip"], "left")
    higher = Window.partitionBy("shard").orderBy(F.desc("strip")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("strip").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = full.select("shard", "strip", F.col("n").isNotNull().alias("used"), *[F.sum(c).over(higher).alias(c) for c in ("n", "w")])
    return sums.select("shard", "strip", "used", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("n", "w")]).where("used").drop("used")


def _streamed(rows: DataFrame, shards: int) -> DataFrame:
    names = [c.split()[0] for c in STREAM.split(", ")]
    sorted_ = rows.select(*names).repartitionByRange(shards, "part").sortWithinPartitions("part", "at")
    return sorted_.mapInArrow(_stream, COUNTS)


def count_above(points: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(id, slot, level, n_above, w_above) of each row of points (id, slot long, level long, weight long; other columns are ignored).

    n_above: points of a smaller slot and a strictly larger level; w_above: the sum of their weights (null counts as 0); both 0 if there are none, and
    null for points whose slot or level is null, which are above none. Rows that repeat an id, or have none, are points of their own.
    An empty table gives an empty result. shards: into how many parts slots and levels are cut, up to twice as many with those of one value.
    """
    known = points.where("slot is not null and level is not null").select("id", "slot", "level", F.coalesce("weight", F.lit(0)).alias("weight"))
    cells = known.groupBy("slot", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    cells = stash(cells)
    slots, levels = quantiles(cells, "slot", shards), quantiles(cells, "level", shards)
    cells = cells.withColumn("shard", place(F.col("slot"), slots)).withColumn("strip", place(F.col("level"), levels))

    no, yes, zero = F.lit(False), F.lit(True), F.lit(0).cast("long")
    within = cells.where(~alone(F.col("shard"), slots))
    within = within.select(F.col("shard").alias("part"), F.col("slot").alias("at"), no.alias("seed"), "slot", "level", "n", "w", zero.alias("held"))
    # nothing in a strip of one level is above another cell of it: each shard's cells are a part of their own there
    strip = F.when(alone(F.col("strip"), levels), F.col("strip") + (F.col("shard") + 1) * (len(levels) + 1)).otherwise(F.col("strip")).cast("long").alias("part")
    before = cells.select(strip, F.col("shard").alias("at"), no.alias("seed"), "slot", "level", "n", "w", F.col("n").alias("held"))
    seeds = _grid(cells, len(slots) + 1, len(levels) + 1)
    seeds = seeds.select(strip, F.col("shard").alias("at"), yes.alias("seed"), zero.alias("slot"), zero.alias("level"), "n", "w", zero.alias("held"))
    found = _streamed(within, shards).union(_streamed(before.union(seeds), shards))
    found = stash(found.groupBy("slot", "level").agg(*[F.sum(c).alias(c) for c in ("n_above", "w_above", "held")]))

    out = join_hot(known.drop("weight"), found, ["slot", "level"], "held").select("id", "slot", "level", "n_above", "w_above")
    none = F.lit(None).cast("long")
    rest = points.where("slot is null or level is null").select("id", "slot", "level", none.alias("n_above"), none.alias("w_above"))
    return out.union(rest)


def days(at: Column, kind: str) -> Column:
    """Whole days since 1970 of a time, taken as UTC whatever the session's zone. kind: its type's name."""
    return F.unix_date(at.cast("date")).cast("long") if kind == "timestamp_ntz" else F.floor(F.unix_seconds(at) / 86400)


def sales_points(sales: DataFrame) -> DataFrame:
    """(id, slot, level, weight) of sales (sale_id, total, sold_at). A total that is no number or infinite has no level; a null sale_id weighs as an empty one."""
    total = F.when(~F.isnan("total") & (F.abs("total") < float("inf")), F.col("total"))
    level = F.floor(F.floor(100 * total + 0.5).cast("double") / 1000)
    c = F.crc32(F.coalesce(F.col("sale_id").cast("string"), F.lit("")).cast("binary"))
    return sales.select(F.col("sale_id").alias("id"), days(F.col("sold_at"), sales.schema["sold_at"].dataType.typeName()).alias("slot"), level.alias("level"), (1 + c % 3).alias("weight"))


def op12_dominance_counting(spark, sf_dir: str) -> DataFrame:
    found = count_above(sales_points(table(spark, sf_dir, "sales")))
    return found.toDF("sale_id", "slot", "level", "n_sales", "n_rows")


ORACLE = f"""
WITH p AS (SELECT sale_id, floor(epoch(sold_at) / 86400)::BIGINT AS slot, floor(floor(100 * total + 0.5::DOUBLE) / 1000)::BIGINT AS level,
  1 + {crc_sql('sale_id::VARCHAR')} % 3 AS weight FROM sales, {CRC_TABLE}),
c AS (SELECT slot, level, count(*) AS n, sum(weight) AS w FROM p WHERE slot IS NOT NULL AND level IS NOT NULL GROUP BY slot, level),
r AS (SELECT c.slot, c.level, coalesce(sum(o.n), 0)::BIGINT AS n_sales, coalesce(sum(o.w), 0)::BIGINT AS n_rows
  FROM c LEFT JOIN c AS o ON o.slot < c.slot AND o.level > c.level GROUP BY c.slot, c.level)
SELECT sale_id, p.slot, p.level, n_sales, n_rows FROM p LEFT JOIN r ON p.slot = r.slot AND p.level = r.level
"""

QUERIES = {"op12_dominance_counting": op12_dominance_counting}
ORACLES = {"op12_dominance_counting": ORACLE}
