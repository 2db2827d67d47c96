"""Quality of extraction: token coverage, reading order and structural defects of fragments against their source.

A page is one row: (doc_id, page_number, source, body, rest), arrays of tokens. What is missed, which
occurrence is which, and how far the order holds is worked out within it, for many pages at once by
array arithmetic on Arrow's buffers, so nothing is shuffled but to bring a page's two sides together.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.pandas.types import to_arrow_schema

from pagewright.functions import geometry as G
from pagewright.functions import text as T
from pagewright.functions.normalise import nfkc_columns
from pagewright.functions.steps import bind, once
from pagewright.operators import ocr, pages
from pagewright.schema import BULLETS, LIMITS

PAGE = ["doc_id", "page_number"]
#: Tokens that are compared at once.
STEP = 100_000
SAMPLE = 10
COMPARED = (
    "doc_id long, page_number int, n_source long, n_missing long, coverage double, matched long, order_score double, "
    "missing array<struct<token:string,n_missing:long>>, matches array<struct<source_pos:int,extracted_pos:int>>"
)


def source_tokens(raw_pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, was_ocr, tokens) of RAW_PAGE rows: what a page says, whatever extraction makes of it.

    Of a sound text layer all text blocks, cleaned; else all detections, cleaned together, but those that lie in images. Callouts and margins are left in.
    Both kinds of pages are read in one pass.
    """
    d = once(raw_pages.select(*PAGE, "blocks", "ocr"), "was_ocr", bind(pages.raw_page_text(F.col("blocks")), T.is_garbled))
    # what has to be normalised, and no more: a page's spans by block and line, or its detections
    line = lambda x: F.struct(F.transform(x["spans"], lambda s: F.struct(s["text"].alias("text"))).alias("spans"))
    spans = F.transform(pages.text_blocks(F.coalesce("blocks", F.array())), lambda b: F.struct(F.transform(b["lines"], line).alias("lines")))
    images = F.transform(F.filter("blocks", lambda b: b["type"] == 1), lambda b: ocr.pixels(G.from_array(b["bbox"])))
    found = F.coalesce("ocr", F.array().cast(raw_pages.schema["ocr"].dataType))
    seen = bind(images, lambda own: F.transform(F.filter(ocr.boxes(found), lambda b: ~F.exists(own, lambda r: G.covered(b, r, LIMITS.covered))), lambda b: b["text"]))
    d = nfkc_columns(d.select(*PAGE, "was_ocr", F.filter(spans, lambda b: ~F.col("was_ocr")).alias("spans"), F.filter(seen, lambda t: F.col("was_ocr")).alias("seen")), ["spans", "seen"])
    read = T.clean(F.array_join(F.transform("seen", T.strip), " "), False)
    sound = F.array_join(F.transform("spans", lambda b: T.clean(pages.raw_text(b), False)), " ")
    return once(d.select(*PAGE, "was_ocr", F.when(F.col("was_ocr"), read).otherwise(sound).alias("tokens")), "tokens", T.tokens(F.col("tokens")))


def block_texts(blocks: Column) -> Column:
    """What a page's blocks say, in order: texts, table cells, and images' alternatives or captions."""

    def own(b: Column) -> Column:
        none = F.array().cast("array<string>")
        text = F.when(F.length(b["text"]) > 0, F.array(b["text"])).otherwise(none)
        cells = F.when(b["type"] == "table", F.coalesce(F.flatten(b["rows"]), none)).otherwise(none)
        label = F.when(F.length(b["alt"]) > 0, b["alt"]).otherwise(b["caption"])
        picture = F.when(b["type"].isin("img", "img_placeholder") & (F.length(label) > 0), F.array(label)).otherwise(none)
        return F.concat(text, cells, picture)

    return F.flatten(F.transform(blocks, own))


def field_tokens(fragments: DataFrame, *keep: Column) -> DataFrame:
    """(doc_id, page_number, body, rest, findings): tokens of blocks, and those of margins and callouts; `keep`: further columns to pass on."""
    joined = lambda c: T.tokens(F.array_join(c, " "))
    rest = F.concat(joined(F.col("margin")), joined(F.col("callout")))
    return fragments.select(*PAGE, joined(block_texts(F.col("blocks"))).alias("body"), rest.alias("rest"), structural_findings(F.col("blocks"), F.col("margin")).alias("findings"), *keep)


def longest_rise(values: list[int]) -> int:
    """Length of the longest non-decreasing subsequence, in n log n."""
    ends: list[int] = []  # the least end of a rise of each length
    for x in values:
        at = bisect_right(ends, x)
        ends[at : at + 1] = [x]
    return len(ends)


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, places by key in order, first of each key's places, how many): for keys in their order."""
    order = np.argsort(keys, kind="stable")
    names, first, many = np.unique(keys[order], return_index=True, return_counts=True)
    return names, order, first, many


def _at(names: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """values of keys; 0 for what isn't among names, which ascend."""
    if len(names) == 0:
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    return np.where(names[at] == keys, values[at], 0)


def _offsets(pages_: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(pages_, np.arange(n + 1))


def _compared(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    n = len(batch)
    flat, page = [], []
    for name in ("source", "body", "rest"):
        column = batch.column(name)
        lens = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        flat.append(column.flatten().cast(pa.string()))
        page.append(np.repeat(np.arange(n, dtype=np.int64), lens))
    words = pa.concat_arrays(flat).dictionary_encode()
    codes = np.split(words.indices.to_numpy().astype(np.int64), np.cumsum([len(x) for x in flat])[:-1])
    size = len(words.dictionary) + 1
    s, b, r = (p * size + c for p, c in zip(page, codes, strict=True))
    starts = [_offsets(p, n) for p in page]

    # the multiset difference
    names, order, first, many = _places(s)
    lost = np.maximum(many - _at(*np.unique(np.concatenate((b, r)), return_counts=True), names), 0)
    own = names // size
    n_source, n_missing = np.bincount(own, weights=many, minlength=n).astype(np.int64), np.bincount(own, weights=lost, minlength=n).astype(np.int64)
    miss = np.flatnonzero(lost)
    miss = miss[np.lexsort((order[first[miss]], -lost[miss], own[miss]))]
    at = _offsets(own[miss], n)
    miss = miss[np.arange(len(miss)) - at[own[miss]] < SAMPLE]
    sample = pa.StructArray.from_arrays([words.dictionary.take(pa.array(names[miss] % size)), pa.array(lost[miss].astype(np.int64))], ["token", "n_missing"])
    missing = pa.ListArray.from_arrays(pa.array(_offsets(own[miss], n), pa.int32()), sample)

    # a token's k-th occurrence in one is its k-th in the other
    _, b_order, b_first, b_many = _places(b)
    k = np.empty(len(b), np.int64)
    k[b_order] = np.arange(len(b)) - np.repeat(b_first, b_many)
    hit = np.flatnonzero(k < _at(names, many, b))
    from_ = order[_at(names, first, b[hit]) + k[hit]] - starts[0][page[1][hit]]
    to = hit - starts[1][page[1][hit]]
    at = _offsets(page[1][hit], n)
    matched = np.diff(at)
    seq = from_.tolist()
    score = [1.0 if m < 4 else longest_rise(seq[x : x + m]) / m for x, m in zip(at[:-1].tolist(), matched.tolist(), strict=True)]

    made = {
        "n_source": pa.array(n_source), "n_missing": pa.array(n_missing), "coverage": pa.array(1 - n_missing / np.maximum(1, n_source)), "matched": pa.array(matched.astype(np.int64)),
        "order_score": pa.array(score, pa.float64()), "missing": missing,
    }
    if "matches" in schema.names:
        pairs = pa.StructArray.from_arrays([pa.array(from_.astype(np.int32)), pa.array(to.astype(np.int32))], ["source_pos", "extracted_pos"])
        made["matches"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pairs)
    return pa.RecordBatch.from_arrays([(made[f.name] if f.name in made else batch.column(f.name)).cast(f.type) for f in schema], schema=schema)


def compare(tokens: DataFrame, keep: tuple[str, ...] = (), matches: bool = True) -> DataFrame:
    """COMPARED of each of tokens (doc_id, page_number, source, body, rest), arrays of tokens in reading order; null ones are empty. `keep`: further columns to pass on.
    Without `matches` there is no such column: a pair for each token takes longer to bring back than to find.

    n_missing: source tokens, as a multiset, that neither body nor rest has; coverage is 1 without a source token. missing: the ten tokens most
    missed, of equal ones the first in the source. matches: a token's k-th occurrence in source is its k-th in body; in the order of body.
    order_score: the longest rise of the matches' source places, over their number; fewer than 4 score 1. Repeated pages come out once each.
    """
    sides = ("source", "body", "rest")
    d = tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page_number").cast("int").alias("page_number"), *[F.col(c).cast("array<string>").alias(c) for c in sides], *keep)
    schema = T_.StructType([*[f for f in T_.StructType.fromDDL(COMPARED) if matches or f.name != "matches"], *[d.schema[c] for c in keep]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lens = sum(pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in sides)
            upto, at = np.cumsum(lens), 0
            while at < len(batch):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP, "right")))
                yield _compared(batch.slice(at, to - at), arrow)
                at = to

    return d.mapInArrow(run, schema)


def structural_findings(blocks: Column, margin: Column) -> Column:
    """array<struct<block, rule>>; block is the place from 0, null for the margin."""

    def own(b: Column, i: Column) -> Column:
        text = F.coalesce(b["text"], F.lit(""))
        before = F.coalesce(F.get(blocks, i - 1)["text"], F.lit(""))
        rules = {
            "bullet_inside": b["type"].isin("p", "li") & F.substr(text, F.lit(2)).rlike(f"[{BULLETS}]"),
            "code_on_one_line": (b["type"] == "code") & ~F.contains(text, F.lit("\n")),
            "ragged_table": (b["type"] == "table") & (F.size(F.array_distinct(F.transform(b["rows"], F.size))) > 1),
            "ends_in_hyphen": b["type"].isin("p", "li", "h") & T.rstrip(text).endswith("-"),
            "repeats_block": (text != "") & (i > 0) & (text == before),
        }
        found = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(i.alias("block"), F.lit(name).alias("rule"))) for name, c in rules.items()])
        return F.filter(found, lambda x: x.isNotNull())

    words = F.aggregate(margin, F.lit(0), lambda a, m: a + F.size(T.tokens(m)))
    long = F.when(words > LIMITS.margin_words, F.array(F.struct(F.lit(None).cast("int").alias("block"), F.lit("long_margin").alias("rule"))))
    return F.concat(F.flatten(F.transform(blocks, own)), F.coalesce(long, F.array().cast("array<struct<block:int,rule:string>>")))


def audit(source: DataFrame, fragments: DataFrame) -> DataFrame:
    """One row for each fragment: COMPARED but matches, findings, score, reasons, missing_sample.

    source: (doc_id, page_number, tokens) in reading order, as source_tokens() gives them. Pages without a source token cover all; order ignores margins
    and callouts. Both sides are read once and meet in one join; all else is within a page's row.
    """
    return _audited(field_tokens(fragments).join(source.select(*PAGE, F.col("tokens").alias("source")), PAGE, "left"))


def audit_rows(pages_: DataFrame) -> DataFrame:
    """audit() of fragments that have their source's tokens beside them, as `tokens`: nothing is joined."""
    return _audited(field_tokens(pages_, F.col("tokens").alias("source")))


def _audited(sides: DataFrame) -> DataFrame:
    d = compare(sides, keep=("findings",), matches=False)
    low = F.col("coverage") < LIMITS.coverage
    mixed = (F.col("order_score") < LIMITS.order) & (F.col("matched") >= LIMITS.order_matched)
    score = F.when(low, (LIMITS.coverage - F.col("coverage")) * 100).otherwise(0.0) + F.when(mixed, (LIMITS.order - F.col("order_score")) * 80).otherwise(0.0) + F.size("findings") * 10
    reasons = F.array_compact(F.concat(F.array(F.when(low, "coverage"), F.when(mixed, "order")), F.transform("findings", lambda f: F.concat_ws(":", f["rule"], f["block"].cast("string")))))
    return d.withColumn("score", score).withColumn("reasons", reasons).withColumn("missing_sample", F.transform("missing", lambda x: x["token"])).drop("missing")


def worst_pages(audited: DataFrame, n: int = 30) -> DataFrame:
    """The n pages of the greatest scores above 0, with their first four reasons."""
    return audited.where("score > 0").orderBy(F.col("score").desc(), *PAGE).limit(n).withColumn("reasons", F.slice("reasons", 1, 4))
