"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of whole documents of one partition, of about SHARD_WORDS words. Its alphabet
is the benchmark's vocabulary; any other word can be in no occurrence and ends a segment, as
a text's end does, and segments shorter than the shortest window are left out. Over the
segments stand a suffix array (prefix doubling on unresolved groups alone), the Burrows-Wheeler
transform in a wavelet matrix, and suffix positions sampled every SAMPLE words and at each
segment's start. All windows search backwards at once; occurrences are located by walking to
a sample; their words merge into removal spans. No row is shuffled.

The benchmark is cut into pieces of PIECE_WORDS words that overlap by a window less one word, so all
windows of an item, however long, are in its pieces. Pieces go by hash to blocks of about BLOCK_CHARS characters;
one block at a time is made on the driver, and one at a time is held by a worker, which reads a shard's
documents once and searches them block by block. Of a block's windows only those are searched whose words all occur in the shard.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import stash, table
from ._words import ALNUM, buffers, word_bounds, word_hashes

SHARD_WORDS = 1_000_000
SAMPLE = 8
BLOCK_CHARS = 1_000_000
PIECE_WORDS = 2_000
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Of symbols s, each 0 a separator unlike any other and less than all symbols; s ends with one."""
    n = len(s)
    zero = s == 0
    key = np.where(zero, np.cumsum(zero), s.astype(np.int64) + zero.sum() + 1)
    sa = np.argsort(key, kind="stable")
    sorted_ = key[sa]
    head = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    k = 1
    while True:
        alone = head & np.concatenate((head[1:], [True]))
        slots = np.flatnonzero(~alone)
        if len(slots) == 0:
            return sa
        at = sa[slots]  # a group's members reach no separator within k, so at + k is in the text
        one, two = rank[at], rank[at + k]
        order = np.lexsort((two, one))
        at, one, two = at[order], one[order], two[order]
        sa[slots] = at
        new = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
        head[slots] = new
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        k *= 2


class FMIndex:
    def __init__(self, s: np.ndarray, sigma: int):
        sa = suffix_array(s)
        self.n = len(s)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=sigma + 1))))
        bwt = s[sa - 1]
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(max(1, int(sigma).bit_length()) - 1, -1, -1):
            ones = (bwt >> bit) & 1
            upto = np.concatenate(([0], np.cumsum(ones, dtype=np.int32)))
            self.levels.append((bit, upto, self.n - int(upto[-1])))
            bwt = np.concatenate((bwt[ones == 0], bwt[ones == 1]))
        sampled = (sa % SAMPLE == 0) | (s[sa - 1] == 0)
        self.sampled_upto = np.concatenate(([0], np.cumsum(sampled, dtype=np.int32)))
        self.samples = sa[sampled]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the transform's first i symbols are c."""
        start = np.zeros_like(i)
        for bit, upto, zeros in self.levels:
            one = (c >> bit) & 1 == 1
            start = np.where(one, zeros + upto[start], start - upto[start])
            i = np.where(one, zeros + upto[i], i - upto[i])
        return i - start

    def back(self, i: np.ndarray) -> np.ndarray:
        """The row of the suffix one longer than that of row i; not across a separator."""
        row, c, start = i, np.zeros_like(i), np.zeros_like(i)
        for bit, upto, zeros in self.levels:
            one = upto[row + 1] > upto[row]
            c = c | (one.astype(np.int64) << bit)
            start = np.where(one, zeros + upto[start], start - upto[start])
            row = np.where(one, zeros + upto[row], row - upto[row])
        return self.before[c] + row - start

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first row, row after the last) of each row of patterns, backwards."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, j]
            lo[live] = self.before[c] + self.rank(c, lo[live])
            hi[live] = self.before[c] + self.rank(c, hi[live])
            live = live[hi[live] > lo[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, live, row, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(live):
            done = self.sampled_upto[row + 1] > self.sampled_upto[row]
            out[live[done]] = self.samples[self.sampled_upto[row[done]]] + steps
            live, row = live[~done], row[~done]
            row = self.back(row)
            steps += 1
        return out


class Windows:
    """Windows of `width` words of the items of one block of the benchmark, by length: (length, words, first owner of each, owners)."""

    def __init__(self, items: list[tuple[int | None, str | None]], width: int):
        raw, offs = buffers(pa.array([t for _, t in items], pa.string()))
        starts, ends, counts = word_bounds(raw, offs, ALNUM)
        hashes = word_hashes(raw, starts, ends)
        self.vocab = np.unique(hashes)
        ids = (np.searchsorted(self.vocab, hashes) + 1).astype(np.int32)
        first = np.cumsum(counts) - counts
        named = np.array([i is not None for i, _ in items], bool)
        numbers = np.array([i or 0 for i, _ in items], np.int64)
        self.groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for length in np.unique(np.minimum(counts[counts > 0], width)).tolist():
            own = np.flatnonzero(np.minimum(counts, width) == length)
            many = counts[own] - length + 1
            item = np.repeat(own, many)
            at = np.repeat(first[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            rows, which = np.unique(ids[at[:, None] + np.arange(length)], axis=0, return_inverse=True)
            pairs = np.unique(np.stack((which.ravel()[named[item]], numbers[item[named[item]]])), axis=1)
            self.groups.append((length, rows, np.searchsorted(pairs[0], np.arange(len(rows) + 1)), pairs[1]))
        self.shortest = self.groups[0][0] if self.groups else 0


def pieces(width: int):
    """(item_id, text) of items cut into pieces that overlap by width - 1 words; an item of PIECE_WORDS words or fewer is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = buffers(batch.column("text"))
            starts, ends, counts = word_bounds(raw, offs, ALNUM)
            head = np.concatenate(([0], np.cumsum(counts)))
            ids, texts = [], []
            for d, item in enumerate(batch.column("item_id").to_pylist()):
                at = int(head[d])
                while at < head[d + 1]:
                    to = min(int(head[d + 1]), at + PIECE_WORDS + width - 1)
                    ids.append(item)
                    texts.append(raw[starts[at] : ends[to - 1]].tobytes().decode())
                    at = at + PIECE_WORDS if to < head[d + 1] else to
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["item_id", "text"])

    return run


def _held_no_longer(shared: Broadcast):
    """A broadcast's value, which the process then doesn't keep."""
    value = shared.value
    vars(shared).pop("_value", None)
    return value


def _shard(windows: Windows, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, dict[int, set[int]]]:
    """(which words are hit, items by document) of a shard's documents, given by their words."""
    hit = np.zeros(len(hashes) + 1, np.int32)
    items: dict[int, set[int]] = defaultdict(set)
    if not windows.groups or len(hashes) == 0:
        return hit[:-1] > 0, items
    place = np.minimum(np.searchsorted(windows.vocab, hashes), len(windows.vocab) - 1)
    known = windows.vocab[place] == hashes
    doc_start = np.zeros(len(hashes) + 1, bool)
    doc_start[np.concatenate(([0], np.cumsum(counts)))] = True
    starts = np.flatnonzero(known & (doc_start[:-1] | ~np.concatenate(([False], known[:-1]))))
    ends = np.flatnonzero(known & (doc_start[1:] | ~np.concatenate((known[1:], [False])))) + 1
    keep = ends - starts >= windows.shortest
    starts, lens = starts[keep], (ends - starts)[keep]
    if len(starts) == 0:
        return hit[:-1] > 0, items
    heads = np.concatenate(([0], np.cumsum(lens + 1)))  # one separator after each segment
    text = np.zeros(heads[-1], np.int64)
    source = np.repeat(starts - heads[:-1], lens + 1) + np.arange(heads[-1])
    inner = np.ones(len(text), bool)
    inner[heads[1:] - 1] = False
    text[inner] = place[source[inner]] + 1
    index = FMIndex(text, len(windows.vocab))
    last = np.cumsum(counts)
    present = np.zeros(len(windows.vocab) + 1, bool)
    present[text] = True
    for length, rows_, first, owners in windows.groups:
        able = np.flatnonzero(present[rows_].all(axis=1))
        patterns = rows_[able].astype(np.int64)
        lo, hi = index.search(patterns)
        found = np.flatnonzero(hi > lo)
        if len(found) == 0:
            continue
        size = (hi - lo)[found]
        rows = np.repeat(lo[found] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        at = source[index.locate(rows)]
        np.add.at(hit, at, 1)
        np.add.at(hit, at + length, -1)
        docs = np.searchsorted(last, at, "right")
        for d, w in np.unique(np.stack((docs, np.repeat(able[found], size))), axis=1).T.tolist():
            items[d].update(owners[first[w] : first[w + 1]].tolist())
    return np.cumsum(hit[:-1]) > 0, items


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _scan(blocks: list[Broadcast], keep: list[str], schema: pa.Schema, cut: bool):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            sizes = np.diff(buffers(batch.column("text"))[1])
            upto = np.cumsum(sizes)
            while at < len(batch):  # about SHARD_WORDS words of 6 bytes
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SHARD_WORDS * 6, "right")))
                yield batch.slice(at, to - at)
                at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = pickle.loads(_held_no_longer(blocks[0])) if len(blocks) == 1 else None
        for batch in shards(batches):
            raw, offs = buffers(batch.column("text"))
            starts, ends, counts = word_bounds(raw, offs, ALNUM)
            hashes = word_hashes(raw, starts, ends)
            hit, items = np.zeros(len(hashes), bool), defaultdict(set)
            for block in blocks:
                own_hit, own_items = _shard(only or pickle.loads(_held_no_longer(block)), hashes, counts)
                hit |= own_hit
                for d, names in own_items.items():
                    items[d] |= names
            head = np.concatenate(([0], np.cumsum(counts)))
            spans: list = [[] for _ in range(len(batch))]
            ids = [sorted(items[d]) if d in items else [] for d in range(len(batch))]
            for d in np.unique(np.searchsorted(head, np.flatnonzero(hit), "right") - 1).tolist() if hit.any() else []:
                spans[d] = [{"start": a, "end": b} for a, b in _runs(hit[head[d] : head[d + 1]])]
            columns = {name: batch.column(name) for name in keep}
            if cut:
                body = raw.tobytes()
                texts = batch.column("text").to_pylist()
                for d in [d for d, x in enumerate(spans) if x]:
                    out, at = [], int(offs[d])
                    for x in spans[d]:
                        out.append(body[at : starts[head[d] + x["start"]]])
                        at = int(ends[head[d] + x["end"] - 1])
                    texts[d] = b"".join([*out, body[at : offs[d + 1]]]).decode()
                columns["text"] = pa.array(texts, pa.string())
            columns |= {"n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, schema.field("spans").type), "items": pa.array(ids, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)

    return run


def benchmark_blocks(benchmark: DataFrame, width: int) -> list[Broadcast]:
    """Windows of the benchmark (item_id, text) as broadcasts, of about BLOCK_CHARS characters each, made and let go of one after another."""
    spark = benchmark.sparkSession
    cut = stash(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").mapInArrow(pieces(width), "item_id long, text string"))
    chars = cut.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // BLOCK_CHARS) or 1
    out = []
    for b in range(n):
        part = cut.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else cut
        out.append(spark.sparkContext.broadcast(pickle.dumps(Windows([(r.item_id, r.text) for r in part.collect()], width), protocol=5)))
        vars(out[-1]).pop("_value", None)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, columns: list[str] | None = None, cut: bool = False) -> DataFrame:
    """docs' `columns` (all but text if not given) with n_words, spans and items.

    A window: `width` consecutive words of an item (item_id long, text); all words of an item of
    fewer; an item without words has none. spans: merged runs [start, end) of the words that lie in
    an occurrence of any window, in words from 0, ascending. items: the ids of the items whose
    windows occur, ascending; an item of null item_id makes spans all the same, without an id. With cut, the column text comes too, without the spans' characters.
    Words are runs of ASCII letters and digits and of all non-ASCII, lower-cased in A-Z. Null text
    has no words (and stays null); an empty benchmark hits nothing. Columns named n_words, spans
    or items are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    made = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.LongType()))])
    columns = [c for c in (columns or docs.columns) if c not in made.names and c != "text"]
    blocks = benchmark_blocks(benchmark, width)
    schema = T.StructType([*[docs.schema[c] for c in [*columns, *(["text"] if cut else [])]], *made])
    return docs.select(*columns, "text").mapInArrow(_scan(blocks, columns, to_arrow_schema(schema), cut), schema)


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10, ["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans")


def items_digest(items: list[int]) -> str:
    """items_sha256 of op6."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


QUERIES = {"op6_benchmark_decontamination": op6_benchmark_decontamination}
ORACLES: dict[str, str] = {}
