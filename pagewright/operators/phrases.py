"""All phrases of a table in all texts of another: every pair counts, whatever their ids.

A phrase is known by the hash of its first bytes (64; of a shorter phrase 32, 16, 8, 4, 2 or 1). Each place
of a text is looked up at once; what is found there is then counted on the whole phrase. No row is shuffled.

Phrases are read in blocks of at most BLOCK_CHARS characters, so that what is broadcast stays bounded;
each block passes over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 8_000_000
STEP_BYTES = 4_000_000
HEADS = (64, 32, 16, 8, 4, 2, 1)
BITS = 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def heads(raw: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the `size` bytes from each place of raw (contiguous, size bytes at least)."""
    part = min(size, 8)
    h = np.ndarray(len(raw) - part + 1, f"<u{part}", raw, strides=(1,)).astype(np.uint64) * _A
    width = part
    while width < size:  # of two halves side by side
        h = h ^ (h >> np.uint64(29))
        h = h[:-width] ^ (h[width:] * _B)
        width *= 2
    h ^= h >> np.uint64(29)
    return h * _B


class Phrases:
    def __init__(self, rows: list[tuple]):
        """rows: (item_id, sentence, phrase)."""
        self.owners: dict[bytes, list[tuple]] = {}
        for item, sentence, phrase in rows:
            self.owners.setdefault(phrase.encode(), []).append((item, sentence))
        self.by: dict[int, dict[int, list[bytes]]] = {}
        for p in self.owners:
            size = next(n for n in HEADS if len(p) >= n)
            head = int(heads(np.frombuffer(p, np.uint8, size), size)[0])
            self.by.setdefault(size, {}).setdefault(head, []).append(p)
        self.seen = {}
        for size, known in self.by.items():
            self.seen[size] = np.zeros(1 << BITS, bool)
            self.seen[size][np.array([*known], np.uint64) >> np.uint64(64 - BITS)] = True

    def found(self, raw: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, bytes, int]]:
        """(text, phrase, how many places that don't overlap, from the left) of the texts of raw."""
        for size, known in self.by.items():
            if len(raw) < size:
                continue
            h = heads(raw, size)
            at = np.flatnonzero(self.seen[size][h >> np.uint64(64 - BITS)])
            at = at[np.isin(h[at], np.array([*known], np.uint64))]
            texts = np.searchsorted(offs, at, "right") - 1
            for d, head in sorted(set(zip(texts.tolist(), h[at].tolist(), strict=True))):
                body = raw[offs[d] : offs[d + 1]].tobytes()
                for p in known[head]:
                    if n := body.count(p):
                        yield d, p, n


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            ids, text = batch.column("doc_id"), batch.column("text").cast(pa.large_string())
            _, offsets, data = text.buffers()
            offs = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
            raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            at = 0
            while at < len(batch):
                to = min(len(batch), max(at + 1, int(np.searchsorted(offs, offs[at] + STEP_BYTES, "right")) - 1))
                rows = [(at + d, *owner, n) for d, p, n in own.found(raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]) for owner in own.owners[p]]
                if rows:
                    d, item, sentence, n = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(d)), pa.array(item, pa.int64()), pa.array(sentence, pa.int32()), pa.array(n, pa.int64())], ["doc_id", "item_id", "sentence", "n"])
                at = to

    return run


def phrase_counts(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc_id, item_id, sentence, n): how often each of phrases (item_id, sentence, phrase) stands in each of docs (doc_id, text).

    n counts places that don't overlap, from the left; pairs without a place give no row. Null texts and null or empty
    phrases hold nothing; null ids are kept. An empty table gives no row.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    phrases = phrases.select(F.col("item_id").cast("long").alias("item_id"), F.col("sentence").cast("int").alias("sentence"), "phrase").where("phrase <> ''")
    chars = phrases.agg(F.sum(F.length("phrase"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS) or 1
    out = []
    for b in range(blocks):
        part = phrases.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == b) if blocks > 1 else phrases
        shared = docs.sparkSession.sparkContext.broadcast(Phrases([tuple(r) for r in part.collect()]))
        out.append(docs.mapInArrow(_count(shared), "doc_id long, item_id long, sentence int, n long"))
    return reduce(DataFrame.union, out)
