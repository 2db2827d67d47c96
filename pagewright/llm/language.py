"""Language identification with bit-sliced Bloom filters of character n-grams.

One array of language bitmasks serves as the Bloom filters of all languages: bit l of a place is
place's bit in language l's filter, so one lookup (the AND of HASHES places) returns all languages
that contain an n-gram. A text's popcount per language, less what that filter's false positives add,
decides. The filters are fitted on a bounded, hashed sample of labelled rows; they hold, for each
language, the n-grams at least SHARE as frequent in it as in the language where they are most frequent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import LETTER, char_classes
from ._common import table
from ._words import BASE, MIX_A, U, mix

ORDERS = (3, 4)
HASHES = 2
SHARE = 0.25
MIN_COUNT = 3
CHUNK_CHARS = 250_000


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the n-grams of all texts, the text of each, whether each text has a letter).

    Lower-cased; each character that is no letter counts as a blank; an n-gram holds one blank at most.
    """
    low = [t.lower() for t in texts]
    sizes = np.array([len(t) + 2 for t in low], np.int64)
    cp = np.frombuffer("".join(f" {t} " for t in low).encode("utf-32-le"), np.uint32)
    letter = char_classes()[cp] == LETTER
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    c = np.where(letter, cp, 32).astype(U) * BASE
    has = np.bincount(doc[letter], minlength=len(texts)) > 0
    hashes, docs = [], []
    for n in ORDERS:
        m = len(cp) - n + 1
        if m <= 0:
            continue
        h, full = np.full(m, U(n)), np.zeros(m, np.int8)
        for j in range(n):
            h *= MIX_A
            h ^= h >> U(29)
            h += c[j : j + m]
            full += letter[j : j + m]
        ok = full >= n - 1
        hashes.append(mix(h[ok]))
        docs.append(doc[:m][ok])
    if not hashes:
        return np.zeros(0, U), np.zeros(0, np.int32), has
    return np.concatenate(hashes), np.concatenate(docs), has


def chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    at, size, held = 0, 0, []
    for i, t in enumerate(texts):
        held.append(t)
        size += len(t)
        if size >= CHUNK_CHARS:
            yield at, held
            at, size, held = i + 1, 0, []
    if held:
        yield at, held


@dataclass
class Filters:
    languages: list[str]  # the most frequent in the sample first: ties of evidence go to the earlier
    masks: np.ndarray  # language bitmasks, in words of 64 languages: (words, places)
    false_positive: np.ndarray  # by language

    @classmethod
    def build(cls, languages: list[str], members: list[np.ndarray], places: int) -> Filters:
        words = -(-len(languages) // 64)
        kind = np.uint8 if len(languages) <= 8 else U
        masks = np.zeros((words, places), kind)
        for i, own in enumerate(members):
            for at in spots(own, places):
                masks[i // 64, at] |= kind(1 << (i % 64))
        filled = np.array([((masks[i // 64] >> kind(i % 64)) & kind(1)).mean() for i in range(len(languages))])
        return cls(languages, masks, filled**HASHES)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names: list[str] = []
        scores = np.zeros(len(texts))
        for at, part in chunks([t or "" for t in texts]):
            h, doc, has = grams(part)
            total = np.bincount(doc, minlength=len(part)).astype(float)
            counts = np.zeros((len(part), len(self.languages)))
            if len(h) and self.languages:
                order = spots(h, self.masks.shape[1])
                for w, masks in enumerate(self.masks):
                    found = masks[order[0]]
                    for spot in order[1:]:
                        found = found & masks[spot]
                    for i in range(w * 64, min(len(self.languages), w * 64 + 64)):
                        hit = (found >> found.dtype.type(i % 64)) & found.dtype.type(1)
                        counts[:, i] = np.bincount(doc, weights=hit, minlength=len(part))
                counts = np.maximum(0, (counts - total[:, None] * self.false_positive) / np.maximum(1e-9, 1 - self.false_positive))
            best = counts.argmax(axis=1) if self.languages else np.zeros(len(part), int)
            whole = counts.sum(axis=1)
            for d in range(len(part)):
                known = bool(has[d]) and bool(self.languages)
                names.append(self.languages[best[d]] if known else "und")
                scores[at + d] = counts[d, best[d]] / whole[d] if known and whole[d] > 0 else 0.0
        return names, scores


def spots(h: np.ndarray, places: int) -> list[np.ndarray]:
    """The places of n-grams in a filter of a power of two places."""
    size = U(places.bit_length() - 1)
    return [((h >> U(20 * j)) & U((1 << int(size)) - 1)).astype(np.int64) for j in range(HASHES)]


def fit(labelled: DataFrame, per_language: int = 2000, places: int = 1 << 20) -> Filters:
    """Filters from labelled (doc_id, text, lang). Of each language about per_language rows are read, chosen by a hash of doc_id; whole texts. Null text or lang are left out.

    The driver holds a row a language, as the model itself does: a bit of each mask and a name.
    """
    labelled = labelled.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    rows = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(rows, key=lambda x: (-rows[x], x))
    if not languages:
        return Filters([], np.zeros((1, places), np.uint8), np.zeros(0))
    part = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, per_language / rows[name]))])
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) < part[F.col("lang")] * 1_000_000)
    index = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array([index[x] for x in batch.column("lang").to_pylist()])
            for at, texts in chunks(batch.column("text").to_pylist()):
                h, doc, _ = grams(texts)
                own = lang[at : at + len(texts)][doc]
                for i in np.unique(own):
                    g, n = np.unique(h[own == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), i, np.int32)), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["language", "gram", "n"])

    sums = drawn.select("lang", "text").mapInArrow(count, "language int, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    got = sums.where(F.col("n") >= MIN_COUNT).toPandas()  # of a sample of bounded size
    total = np.maximum(1, got.groupby("language")["n"].sum().reindex(range(len(languages)), fill_value=0).to_numpy())
    got["share"] = got["n"] / total[got["language"]]
    got = got[got["share"] >= SHARE * got.groupby("gram")["share"].transform("max")]
    members = [got.loc[got["language"] == i, "gram"].to_numpy(np.int64).view(U) for i in range(len(languages))]
    return Filters.build(languages, members, places)


def identify(docs: DataFrame, filters: Filters, columns: list[str] | None = None) -> DataFrame:
    """docs' `columns` (all if not given) with lang_pred and score, replacing columns of these names.

    lang_pred: the language with most n-grams, `und` where text is null or has no letter, or no language was learned. score: its part of all
    languages' evidence, 0 to 1; 0 where no n-gram is known (lang_pred is then the most frequent language). Ties go to the language with
    more labelled rows, then the smaller name. Rows are independent.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    keep = [c for c in (columns or docs.columns) if c not in ("lang_pred", "score")]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # `places` bytes for each 8 languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 250):
                part = batch.slice(at, 250)
                names, scores = shared.value.predict(part.column("text").to_pylist())
                columns = [part.column(c) for c in keep] + [pa.array(names, pa.string()), pa.array(scores)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def held_out():
    """Documents no filter is fitted on: crc32 of the doc_id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_language_bitmask_bloom(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = fit(docs.where(~held_out()))
    found = identify(docs.select("doc_id", "text"), filters, ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language_bitmask_bloom": op7_language_bitmask_bloom}
ORACLES: dict[str, str] = {}
