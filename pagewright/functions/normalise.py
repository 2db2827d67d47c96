"""Unicode compatibility composition (NFKC) of every string in nested columns.

Arrow's own kernel for it leaves letters decomposed in the version used here, so Python's is applied, once to each
distinct string of a batch that isn't ASCII; all else stays in Arrow's buffers.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of a batch that are worked on at once.
STEP = 4_000_000


def fold(array: pa.Array) -> pa.Array:
    kind = array.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        if pc.all(pc.string_is_ascii(array), min_count=0).as_py():
            return array
        known = array.dictionary_encode()
        return pa.array([unicodedata.normalize("NFKC", x) for x in known.dictionary.to_pylist()], kind).take(known.indices)
    if pa.types.is_list(kind):
        nulls = array.is_null() if array.null_count else None
        lens = pc.fill_null(pc.list_value_length(array), 0)
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(lens).cast(pa.int32())])
        return pa.ListArray.from_arrays(offsets, fold(array.flatten()), type=kind, mask=nulls)
    if pa.types.is_struct(kind):
        nulls = array.is_null() if array.null_count else None
        return pa.StructArray.from_arrays([fold(array.field(i)) for i in range(kind.num_fields)], fields=list(kind), mask=nulls)
    return array


def slices(batch: pa.RecordBatch, size: int = STEP) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about so many bytes, a row at least."""
    rows = max(1, batch.num_rows * size // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def folded(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches with these columns normalised, in parts: Python's strings take several times the room of Arrow's, and pages may be long."""
    for batch in batches:
        for part in slices(batch):
            arrays = [fold(part.column(i)) if name in columns else part.column(i) for i, name in enumerate(part.schema.names)]
            yield pa.RecordBatch.from_arrays(arrays, names=part.schema.names)


def nfkc_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with all strings in these columns, however deep, normalised."""

    return df.mapInArrow(lambda batches: folded(batches, columns), df.schema)
