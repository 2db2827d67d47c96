"""Cleaning of detected tables, as folds over their rows and columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions.steps import bind
from pagewright.schema import LIMITS


def _empty(cell: Column) -> Column:
    return F.coalesce(cell, F.lit("")) == ""


def clean_cells(rows: Column) -> Column:
    """Cleaned (of text that is normalised already), on one line and stripped; null is empty."""
    return F.transform(rows, lambda r: F.transform(r, lambda c: T.strip(F.regexp_replace(T.clean(c, False), "\n", " "))))


def drop_empty_columns(rows: Column) -> Column:
    """Rows padded to one width; columns that hold nothing in any row go."""

    def narrowed(rows: Column) -> Column:
        wide = F.array_max(F.transform(rows, F.size))
        used = F.filter(F.sequence(F.lit(0), wide - 1), lambda c: F.exists(rows, lambda r: ~T.blank(F.get(r, c))))
        kept = bind(used, lambda used: F.transform(rows, lambda r: F.transform(used, lambda c: F.coalesce(F.get(r, c), F.lit("")))))
        return F.when(wide > 0, kept).otherwise(F.array().cast("array<array<string>>"))

    return bind(rows, narrowed)


def fold_lone_cells(rows: Column) -> Column:
    """A row with one filled cell goes on in the row above if that has the same column filled; empty rows go."""

    def step(kept: Column, row: Column) -> Column:
        def placed(filled: Column) -> Column:
            last = F.get(kept, F.size(kept) - 1)
            at = F.get(filled, F.lit(0))
            wraps = (F.size(filled) == 1) & (F.size(kept) > 0) & ~_empty(F.get(last, at))
            joined = F.transform(last, lambda c, i: F.when(i == at, F.concat(c, F.lit(" "), F.get(row, i))).otherwise(c))
            return (
                F.when(F.size(filled) == 0, kept)
                .when(F.coalesce(wraps, F.lit(False)), F.concat(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))), F.array(joined)))
                .otherwise(F.concat(kept, F.array(row)))
            )

        return bind(F.filter(F.transform(row, lambda c, i: F.when(~_empty(c), i)), lambda i: i.isNotNull()), placed)

    return F.aggregate(rows, F.array().cast("array<array<string>>"), step)


def merge_split_columns(rows: Column) -> Column:
    """From the left, a column joins the group before it unless some row would then hold two different values there."""

    def values(row: Column, group: Column) -> Column:
        return F.array_distinct(F.filter(F.transform(group, lambda c: F.get(row, c)), lambda v: ~_empty(v)))

    def step(groups: Column, c: Column) -> Column:
        def placed(wider: Column) -> Column:
            clash = F.exists(rows, lambda r: F.size(values(r, wider)) > 1)
            return F.when((F.size(groups) == 0) | clash, F.concat(groups, F.array(F.array(c)))).otherwise(F.concat(F.slice(groups, F.lit(1), F.size(groups) - 1), F.array(wider)))

        return bind(F.concat(F.get(groups, F.size(groups) - 1), F.array(c)), placed)

    n = F.size(F.get(rows, F.lit(0)))
    groups = F.aggregate(F.sequence(F.lit(0), n - 1), F.array().cast("array<array<int>>"), step)
    bound = F.transform(F.array(groups), lambda g: F.transform(rows, lambda r: F.transform(g, lambda own: F.coalesce(F.get(values(r, own), F.lit(0)), F.lit("")))))
    return F.when((F.size(rows) > 0) & (n > 0), F.element_at(bound, 1)).otherwise(rows)


def clean_table(rows: Column) -> Column:
    """Cells cleaned, empty columns dropped, wrapped rows and split columns joined; array<array<string>>, empty if nothing is left."""
    bound = F.array(F.coalesce(drop_empty_columns(rows), F.array().cast("array<array<string>>")))
    for step in (clean_cells, fold_lone_cells, merge_split_columns):
        bound = F.transform(bound, step)
    return F.element_at(bound, 1)


def is_table(rows: Column) -> Column:
    return (F.size(rows) >= LIMITS.table_size) & (F.size(F.get(rows, F.lit(0))) >= LIMITS.table_size)
