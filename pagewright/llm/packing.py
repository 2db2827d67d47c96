"""Harmonic packing of token ids into sequences of a fixed capacity.

Class k holds pieces longer than capacity / (k + 1) and at most capacity / k; each of its bins
takes k pieces, whatever their lengths, so workers fill a class's bins knowing only how many
pieces come before theirs. As documents may be cut, a document's rest after whole sequences is cut
where the parts nearly fill their classes (one or two parts, from a table made once for each
capacity). Each class's last pieces, fewer than k, are a bounded rest, packed first-fit by
falling length in one small task. Bins and offsets are found on slim rows; ids, where they are asked for, stay packed
in bytes and meet them in one join on a piece's own key.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._bpe import Encoder
from ._common import rank_buckets, ranked, stash, table

#: What a cut costs, in ids of padding.
CUT = 4


@lru_cache(4)
def cuts(capacity: int) -> list[tuple[int, ...]]:
    """For each length below capacity, the parts to cut it into: least waste, where each further part costs CUT ids.

    A part of class k uses capacity / k of a sequence. All parts but one are as long as their class allows.
    """
    sizes = np.arange(1, capacity + 1)
    waste = np.concatenate(([0.0], capacity / (capacity // sizes) - sizes))
    ends = np.unique(capacity // sizes)  # the classes' longest parts
    cost, out = np.zeros(capacity), [()]
    for n in range(1, capacity):
        cost[n], parts = waste[n], (n,)
        first = ends[ends < n]
        if len(first):
            whole = waste[first] + cost[n - first] + CUT
            i = int(whole.argmin())
            if whole[i] < cost[n]:
                cost[n], parts = whole[i], tuple(sorted((int(first[i]), *out[n - first[i]]), reverse=True))
        out.append(parts)
    return out


def _packed(ids: np.ndarray) -> bytes:
    """Ids as two bytes each if all fit, else as four."""
    return ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes()


def _unpack(names: list[str]):
    """Rows with ids as an array of integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, f"<u{len(x) // n}").astype(np.int32) for x, n in zip(batch.column("ids").to_pylist(), batch.column("length").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names[:-1]], pa.array(ids, pa.list_(pa.int32()))], names)

    return run


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "k"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, plan = Encoder(path), cuts(capacity)
        for batch in batches:
            for at in range(0, len(batch), 100):
                part = batch.slice(at, 100)
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids, counts = encoder.encode(texts)
                rows: list[tuple] = []
                pos = 0
                for doc, n in zip(part.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                    own = np.append(ids[pos : pos + n], np.uint32(end_id)).astype("<u4")
                    pos += n
                    start, total = 0, n + 1
                    for size in (*[capacity] * (total // capacity), *plan[total % capacity]):
                        x = own[start : start + size]
                        rows.append((doc, start, size, zlib.crc32(x.tobytes()), total, capacity // size, _packed(x) if with_ids else None)[: len(names)])
                        start += size
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 5 + [pa.int32()] + [pa.binary()] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _first_fit(capacity: int, first_id: int, names: list[str]):
    """Pieces to bins of the capacity: longest first, each to the fullest bin that has room."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        held = [f for f in frames if len(f)]
        if not held:
            return
        f = pd.concat(held).sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what room they have
        bins, offsets, count = [], [], 0
        for n in f["length"]:
            r = next((r for r in range(n, capacity + 1) if room[r]), None)
            if r is None:
                b, r, count = count, capacity, count + 1
            else:
                b = room[r].pop()
            bins.append(first_id + b)
            offsets.append(capacity - r)
            room[r - n].append(b)
        yield f.assign(sequence_id=bins, offset=offsets)[names]

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of all docs (doc_id, text; other columns are ignored): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids the ids.

    A document is its text's ids, by the tokenizers file `tokenizer` (a path valid on each executor;
    no special tokens are added), then end_id; null and empty texts are end_id alone. Each id lies in exactly one
    piece. Sequences are numbered from 0 without gaps; offsets in each run from 0 without gaps. Rows that repeat a
    doc_id are packed each. An empty table gives no piece.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, k int" + ", ids binary" * with_ids
    made = docs.mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids), schema)
    # the key is written, so it stays the same
    all_ = stash(made.withColumn("key", F.monotonically_increasing_id()) if with_ids else made)
    pieces = all_.drop("ids")
    # one row a class at most: about twice the root of the capacity
    counts = {r.k: r.n for r in pieces.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    base, first = {}, 0
    for k in sorted(counts):
        base[k] = first
        first += counts[k] // k
    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    key = ["key"] * with_ids
    out = [*own, "sequence_id", "offset"]
    if not counts:
        return pieces.select(*own, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *[F.array().cast("array<int>").alias("ids")] * with_ids)
    place = ranked(pieces, ["k"], ["doc_id", "start", "ids_crc32", "length"], F.xxhash64("doc_id"), "_place", rank_buckets(sum(counts.values())))
    by_class = F.create_map(*[F.lit(x) for k in counts for x in (k, base[k])])
    full = F.create_map(*[F.lit(x) for k in counts for x in (k, counts[k] // k * k)])
    place = stash(place.withColumn("_whole", F.col("_place") < full[F.col("k")]))
    whole = place.where("_whole").withColumn("sequence_id", (by_class[F.col("k")] + F.floor(F.col("_place") / F.col("k"))).cast("long"))
    before = Window.partitionBy("sequence_id").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    rest = place.where("not _whole").select(*own, *key).coalesce(1)
    placed = whole.select(*out, *key).union(rest.mapInPandas(_first_fit(capacity, first, [*out, *key]), ", ".join(f"{c} long" for c in [*out, *key])))
    if not with_ids:
        return placed
    return stash(placed).join(all_.select("key", "ids"), "key").select(*out, "ids").mapInArrow(_unpack([*out, "ids"]), ", ".join(f"{c} long" for c in out) + ", ids array<int>")


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_harmonic_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), byte_bpe_path(), 2048, 1)


QUERIES = {"op5_harmonic_packing": op5_harmonic_packing}
ORACLES: dict[str, str] = {}
