"""Words of UTF-8 text as 64-bit hashes, found by whole-array arithmetic on Arrow's buffers.

Both word classes used here are decided byte by byte (every byte of a non-ASCII character is
0x80 or more), so no text is decoded. Blocks of words bound the memory, whatever a text's length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
BASE, MIX_A, MIX_B = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
BLOCK_WORDS = 150_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Any byte but blank, tab, line feed, vertical tab, form feed and carriage return.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII digits and letters and all non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = x ^ (x >> U(30))
    x = x * MIX_A
    x ^= x >> U(27)
    x *= MIX_B
    x ^= x >> U(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def word_bounds(raw: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each word, its end, words of each text) of texts raw[offs[i] : offs[i + 1]]. kind: which bytes make words."""
    if len(raw) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs) - 1, np.int64)
    inside = kind[raw]
    first = np.zeros(len(raw) + 1, bool)  # a text begins here
    first[offs] = True
    starts = np.flatnonzero(inside & (first[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (first[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    return starts, ends, np.searchsorted(starts, offs[1:]) - np.searchsorted(starts, offs[:-1])


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each word, lower-cased in A-Z."""
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        # whole words of at most a few MB together; a longer word is a block of its own
        upto = min(at + BLOCK_WORDS, max(at + 1, int(np.searchsorted(ends, starts[at] + 4_000_000))))
        lens = ends[at:upto] - starts[at:upto]
        head = np.concatenate(([0], np.cumsum(lens)[:-1]))
        place = np.arange(head[-1] + lens[-1]) - np.repeat(head, lens)
        letters = LOWER[raw[np.repeat(starts[at:upto], lens) + place]].astype(U) + U(1)
        power = np.multiply.accumulate(np.full(int(lens.max()), BASE))
        out[at:upto] = np.add.reduceat(letters * power[place], head) ^ (lens.astype(U) * MIX_B)
        at = upto
    return mix(out)


def words(raw: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words of each text)."""
    starts, ends, counts = word_bounds(raw, offs, kind)
    return word_hashes(raw, starts, ends), counts


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of one text's k-word shingles, in order; fewer words make one shingle."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(k, n)
    out = np.full(n - width + 1, mix(np.array([width], U))[0])
    for j in range(width):
        out = mix(out * BASE + hashes[j : n - width + 1 + j])
    return out
