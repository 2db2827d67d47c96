"""SimHash near-duplicates by counts of bits in segments, a grid over those counts, and exact verification.

A fingerprint's 64 bits are cut into segments of SEGMENT bits, each mapped to how many of its bits are set. Two
fingerprints differ in at least as many bits as the Manhattan distance of their counts. So a pair within `bits` agrees on the
counts of all but `bits` segments at most: with the segments in m bands, on all counts of m - bits bands. Each choice of so many bands
is a grid, whose cells are the bands' counts; a fingerprint lies in one cell of each grid, and every pair within reach shares a cell of some grid.
Within a cell pairs are held against the Manhattan distance first and, where it allows, against the fingerprints themselves.

Counts are kept in unary, a segment's set bits moved to its low end: the number of bits in which two such codes differ is
the Manhattan distance of their counts.

Documents of one fingerprint are one class, and classes alone go into the grids. A cell with more than BLOCK of them is compared in blocks of chunk
against chunk, each a task's small work; a block gives out links that connect what it links and no more, so neither a large cell nor a large group of
near copies makes pairs. The number of bands follows the number of fingerprints: more of them make more grids of smaller cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import join_hot, release, stash, table
from .minhash import components

SEGMENT = 2
N_SEGMENTS = 64 // SEGMENT
#: A cell with more fingerprints is compared in blocks of so many by so many.
BLOCK = 2048
#: Runs of up to so many rows are compared all at once, by their distance in the order.
SHORT = 16
#: Shingles that are hashed at a time.
STEP = 100_000
BYTE_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def fingerprint(text: bytes, k: int, seed: int) -> int:
    """The SimHash of a UTF-8 text, as a signed 64-bit integer: bit i is set if it is in over half of the shingles' XXH64."""
    words = text.lower().split()  # of bytes: A-Z alone, and ASCII's six blanks
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - k + 1)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts, ends = (ends - lens)[:n], ends[min(k, len(words)) - 1 :]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        a, b = starts[at : at + STEP].tolist(), ends[at : at + STEP].tolist()
        hashes = np.fromiter((digest(joined[x:y], seed) for x, y in zip(a, b, strict=True)), np.uint64, len(a))
        each = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            counts[8 * byte : 8 * byte + 8] += np.bincount(each[:, byte], minlength=256) @ BYTE_BITS
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, k: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint((t.as_py() or "").encode("utf-8", "surrogatepass"), k, seed) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def counts_code(fp: Column) -> Column:
    """The counts of set bits of a fingerprint's segments of two, each in unary: 0, 1 or 3."""
    low = F.lit(0x5555555555555555)
    after = F.shiftrightunsigned(fp, 1)
    some, both = fp.bitwiseOR(after).bitwiseAND(low), fp.bitwiseAND(after).bitwiseAND(low)
    return some.bitwiseOR(F.shiftleft(both, 1))


def bands_for(n: int, bits: int) -> int:
    """How many bands, bits + 2 at least, are cheapest for n fingerprints, where two segments' counts are equal in 3 of 8 cases and a row in a cell costs as much as 50 comparisons.

    With one band less, cells would be the counts of a single band, and the least of inputs made in another way than all others.
    """

    def cost(m: int) -> float:
        return comb(m, bits) * (1 + n * (3 / 8) ** (N_SEGMENTS * (m - bits) / m) / 50)

    return min(range(bits + 2, min(N_SEGMENTS, bits + 9)), key=cost)


def grids(m: int, bits: int) -> list[int]:
    """Of each choice of m - bits of m bands, the mask of its segments' bits, as a signed 64-bit integer."""
    ends = [N_SEGMENTS * i // m * SEGMENT for i in range(m + 1)]
    bands = [(1 << b) - (1 << a) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    masks = [sum(chosen) for chosen in combinations(bands, m - bits)]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


CELL = ["grid", "cell", "i", "j"]


def _links(bits: int):
    """Of rows (grid, cell, i, j, fp, code), sorted by the first four: links (a, b) within runs of them, as many as connect what is within `bits` of each other."""

    def within(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x ^ y) <= bits

    def short(run: np.ndarray, fp: np.ndarray, code: np.ndarray, out: list) -> None:
        for off in range(1, SHORT):
            p = np.flatnonzero(run[off:] == run[:-off])
            if len(p) == 0:
                return
            p = p[within(code[p], code[p + off])]
            p = p[within(fp[p], fp[p + off])]
            out.append((fp[p], fp[p + off]))

    def long(fp: np.ndarray, code: np.ndarray, out: list) -> None:
        label = np.arange(len(fp))
        for p in range(len(fp) - 1):
            q = p + 1 + np.flatnonzero(within(code[p], code[p + 1 :]))
            q = q[within(fp[p], fp[q])]
            other, first = np.unique(label[q], return_index=True)
            first = first[other != label[p]]
            if len(first):
                out.append((np.full(len(first), fp[p]), fp[q[first]]))
                label[np.isin(label, other)] = label[p]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def flush(rows: list[np.ndarray]) -> pa.RecordBatch:
            *cell, fp, code = rows
            fp, code = fp.view(np.uint64), code.view(np.uint64)
            new = np.zeros(len(fp), bool)
            new[:1] = True
            for c in cell:
                new[1:] |= c[1:] != c[:-1]
            run = np.cumsum(new) - 1
            sizes, out = np.bincount(run), [(fp[:0], fp[:0])]
            few = sizes[run] <= SHORT
            short(run[few], fp[few], code[few], out)
            starts = np.flatnonzero(new)
            for r in np.flatnonzero(sizes > SHORT):
                part = slice(starts[r], starts[r] + sizes[r])
                long(fp[part], code[part], out)
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                own = [np.concatenate(x) for x in zip(held, own, strict=True)]
            if not len(own[0]):
                continue
            # the last run may go on in the next batch
            last = np.ones(len(own[0]), bool)
            for c in own[:4]:
                last &= c == c[-1]
            cut = len(last) - int(last.sum())
            if cut:
                yield flush([c[:cut] for c in own])
            held = [c[cut:] for c in own]
        if held is not None:
            yield flush(held)

    return run


def _cells(codes: DataFrame, bits: int, m: int) -> DataFrame:
    """(grid, cell, i, j, fp, code) of codes (fp, code): each fingerprint's cell in each grid, and its blocks there; i and j are 0 in a cell of one block."""
    masks = F.array(*map(F.lit, grids(m, bits)))
    placed = codes.select("fp", "code", F.posexplode(masks).alias("grid", "mask")).select("grid", F.col("code").bitwiseAND(F.col("mask")).alias("cell"), "fp", "code")
    crowded = placed.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    crowded = stash(crowded.select("grid", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("chunks")))
    # as few rows as a BLOCK-th of the rows at most: Spark broadcasts them if they are small, and splits skewed joins if not
    rows = placed.join(crowded, ["grid", "cell"], "left")
    own, zero = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"), F.lit(0)
    others = F.transform(F.filter(F.sequence(zero, F.col("chunks") - 1), lambda o: o != own), lambda o: F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j")))
    single = F.array(F.struct(zero.alias("i"), zero.alias("j")))
    return rows.select("grid", "cell", F.explode(F.when(F.col("chunks").isNull(), single).otherwise(others)).alias("at"), "fp", "code").select("grid", "cell", "at.i", "at.j", "fp", "code")


def near_duplicates(docs: DataFrame, k: int = 4, bits: int = 4, seed: int = 42, bands: int | None = None) -> DataFrame:
    """(doc_id, fp, n_class, component_id) of each row of docs (doc_id, text; other columns are ignored).

    fp: the SimHash over k-word shingles, a signed integer. Documents whose fingerprints differ in `bits` bits or fewer are linked; component_id is the smallest
    doc_id reachable. n_class: rows of the same fingerprint. Null and empty texts, and those without words, have fingerprint 0, which is linked as any other; fewer words
    than k are one shingle. Rows that repeat a doc_id are rows of their own and come out once each; a row without one takes part, and component_id is null
    where none of those linked has one. An empty table gives an empty result. bands: into how many bands segments are cut, above `bits`; chosen by the fingerprints' number if not given.
    """
    rows = stash(fingerprints(docs, k, seed))
    classes = stash(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")))
    m = bands or bands_for(classes.count(), bits)
    cells = _cells(classes.select("fp", counts_code(F.col("fp")).alias("code")), bits, m)
    dealt = cells.repartition(*CELL).sortWithinPartitions(*CELL)
    found = components(dealt.mapInArrow(_links(bits), "a long, b long").distinct())
    linked = stash(classes.join(found.withColumnRenamed("v", "fp"), "fp"))
    tops = stash(linked.groupBy("component").agg(F.count(F.lit(1)).alias("held"), F.min("least").alias("component_id")))
    named = join_hot(linked, tops, "component", "held").select("fp", "n", "component_id")
    alone = classes.join(linked.select("fp"), "fp", "left_anti").select("fp", "n", F.col("least").alias("component_id"))
    labels = stash(named.union(alone))
    release(classes, linked, tops)
    return join_hot(rows, labels, "fp").select("doc_id", "fp", F.col("n").alias("n_class"), "component_id")


def op13_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op13_simhash_near_dedup": op13_simhash_near_dedup}
ORACLES: dict[str, str] = {}
