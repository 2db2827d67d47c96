"""Byte-level BPE of many texts at once.

Text is cut into the vocabulary's pieces by array arithmetic on code points; each distinct piece
is encoded once and its ids are copied to all its places. Texts that hold a special token's
string, or characters whose class depends on the library's Unicode version, are encoded whole by
the tokenizers library, so that ids always equal that library's.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np

from ._words import BASE, MIX_B, U, mix

OTHER, LETTER, NUMBER, SPACE = range(4)
CHUNK_CHARS = 2_000_000
CACHED = 800_000


@lru_cache(1)
def char_classes() -> np.ndarray:
    import regex

    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        out[[ord(c) for c in regex.findall(pattern, every)]] = kind
    return out


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_starts(cp: np.ndarray, doc_heads: np.ndarray) -> np.ndarray:
    """Where pieces start in the code points cp of texts that start at doc_heads (ascending).

    A piece: an English contraction's ending; letters, numbers or other characters with the blank
    before them; white space, but its last character, if text follows, is apart or goes with it.
    """
    n = len(cp)
    kind = char_classes()[cp]
    new_doc = np.zeros(n + 1, bool)
    new_doc[doc_heads] = new_doc[n] = True
    head = np.concatenate(([True], kind[1:] != kind[:-1])) | new_doc[:n]
    space = kind == SPACE
    after_blank = np.concatenate(([False], cp[:-1] == 32)) & ~new_doc[:n]
    start = head & (space | ~after_blank)
    followed = np.concatenate((~space[1:], [False])) & ~new_doc[1:]  # the next character is in the text and not white
    start |= space & followed
    quote = np.flatnonzero((cp == 39) & start & head)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~new_doc[quote + 1]]
    if len(quote):
        one = cp[quote + 1]
        far = np.minimum(quote + 2, n - 1)
        two = np.where((quote + 2 < n) & ~new_doc[np.minimum(quote + 2, n)], cp[far], 0)
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for pair in ("re", "ve", "ll"):
            size = np.where((one == ord(pair[0])) & (two == ord(pair[1])), 2, size)
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        rest = quote + 1 + size
        start[rest[rest < n]] = True
    return np.flatnonzero(start)


class Encoder:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.bpe = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self._forget()

    def _forget(self) -> None:
        """Empty the cache: hashes of known pieces, ascending, and the row of each; ids of row i are pool[upto[i] : upto[i + 1]]."""
        self.known, self.rows = np.array([0xFFFFFFFFFFFFFFFF], U), np.array([0])
        self.pool, self.upto = array("I"), array("q", [0, 0])

    def _odd(self, text: str, cp: np.ndarray) -> bool:
        return bool(((cp >= 0x590) & ((cp < 0x2000) | (cp >= 0x2C00))).any()) or any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another; how many each has)."""
        ids, counts, held, size = [], [], [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= CHUNK_CHARS:
                a, b = self._chunk(held)
                ids.append(a)
                counts.append(b)
                held, size = [], 0
        if held:
            a, b = self._chunk(held)
            ids.append(a)
            counts.append(b)
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
        odd = [self._odd(t, p) for t, p in zip(texts, points, strict=True)]
        if not any(odd):
            return self._plain(texts, points)
        ids, counts = self._plain([t for t, o in zip(texts, odd, strict=True) if not o], [p for p, o in zip(points, odd, strict=True) if not o])
        parts, sizes, at, plain = [], [], 0, iter(counts.tolist())
        for t, o in zip(texts, odd, strict=True):
            if o:
                own = np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32)
            else:
                n = next(plain)
                own = ids[at : at + n]
                at += n
            parts.append(own)
            sizes.append(len(own))
        return np.concatenate(parts), np.array(sizes, np.int64)

    def _plain(self, texts: list[str], points: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        lens = np.array([len(p) for p in points], np.int64)
        if lens.sum() == 0:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        cp = np.concatenate(points)
        doc_ends = np.cumsum(lens)
        starts = piece_starts(cp, (doc_ends - lens)[lens > 0])
        size = np.diff(np.concatenate((starts, [len(cp)])))
        power = np.multiply.accumulate(np.full(int(size.max()), BASE))
        place = np.arange(len(cp)) - np.repeat(starts, size)
        hashes = mix(np.add.reduceat((cp.astype(U) + U(1)) * power[place], starts) ^ (size.astype(U) * MIX_B))
        del place
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > CACHED:
            self._forget()
        spot = np.searchsorted(self.known, distinct)
        seen = self.known[np.minimum(spot, len(self.known) - 1)] == distinct
        rows = np.empty(len(distinct), np.int64)
        rows[seen] = self.rows[spot[seen]]
        new = np.flatnonzero(~seen)
        if len(new):
            body = "".join(texts).encode()
            at = np.concatenate(([0], np.cumsum(1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF).astype(np.int8), dtype=np.int64)))
            lo = starts[first[new]]
            encode, add, upto = self.bpe._core_bpe.encode_single_piece, self.pool.extend, self.upto.append
            for a, b in zip(at[lo].tolist(), at[lo + size[first[new]]].tolist(), strict=True):
                add(encode(body[a:b]))
                upto(len(self.pool))
            rows[new] = np.arange(len(self.upto) - 1 - len(new), len(self.upto) - 1)
            self.known = np.concatenate((self.known, distinct[new]))
            self.rows = np.concatenate((self.rows, rows[new]))
            order = np.argsort(self.known, kind="stable")
            self.known, self.rows = self.known[order], self.rows[order]
        bounds, pool = np.array(self.upto, np.int64), np.array(self.pool, np.uint32)
        own = rows[which]
        lo = bounds[own]
        n = bounds[own + 1] - lo
        ends = np.cumsum(n)
        ids = pool[np.repeat(lo - (ends - n), n) + np.arange(ends[-1])]
        upto = np.concatenate(([0], ends))[np.searchsorted(starts, np.concatenate(([0], doc_ends)))]
        return ids, np.diff(upto)
