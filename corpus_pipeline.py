"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet
and read again as the next one's docs. All but the last return the columns of docs. They work
on all that the stage before kept; only what a stage says goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import decontaminate as decontamination
from pagewright.llm import language, minhash, packing, pii
from pagewright.llm._common import release, stash, table


def _with_length(df: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of df, n_chars (if there) counted anew."""
    return df.select(*[F.length("text").cast(df.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c) for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose text is null, has no letter, or holds no known n-gram of any language; a null lang becomes the predicted one.

    If no language could be learned (no labelled row outside the held-out quarter), all documents with a letter stay as they are, a null lang too.
    """
    filters = language.fit(docs.where(~language.held_out()))
    if not filters.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    own = ["doc_id", "text", "lang", *[c for c in docs.columns if c not in ("doc_id", "text", "lang", "lang_pred", "score")]]
    kept = language.identify(docs.select(*own), filters).where((F.col("lang_pred") != "und") & (F.col("score") > 0))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*[c for c in docs.columns if c in own])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similarity 0.8 or more of 5-word shingles, the document of the smallest doc_id stays; documents without a word stay.

    Rows that share a doc_id, or have none, are told apart: each goes only if its own text is linked to one that stays: of a group the first by
    doc_id (null last), then by a hash of the text, then as they come.
    """
    unique = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id is null or n > 1").isEmpty()
    own = docs.withColumn("_row", F.col("doc_id")) if unique else stash(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = minhash.near_duplicates(own.select(F.col("_row").alias("doc_id"), "text"), k=5, percent=80, unique=True)
    if unique:
        kept = found.where("kept").select(F.col("doc_id").alias("_row"))
    else:
        by_row = found.select(F.col("doc_id").alias("_row"), "component_id").join(own.select("_row", "doc_id", F.xxhash64("text").alias("h")), "_row")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "_row"))
        kept = by_row.groupBy("component_id").agg(first["_row"].alias("_row")).select("_row")
    return own.join(kept.hint("shuffle_hash"), "_row", "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 10 or more words that `benchmark` holds are cut out; documents go of which no word is left but had one."""
    found = decontamination.decontaminate(docs.drop("n_words", "spans", "items"), table(spark, sf_dir, "benchmark"), 10, cut=True)
    hit = F.aggregate("spans", F.lit(0), lambda a, x: a + x["end"] - x["start"])
    return _with_length(found.where((F.size("spans") == 0) | (hit < F.col("n_words"))), docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kinds; no document goes."""
    return _with_length(pii.find_personal_data(docs.drop("spans"), redacted=True), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their ids, in sequences of 2048 ids; each document ends with id 1."""
    return packing.pack(docs, packing.byte_bpe_path(), 2048, 1, with_ids=True)


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("PII", redact_personal_data),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to documents; each result but the last is written to the shared folder, and goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        made = stash(stage(spark, docs, sf_dir))
        release(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
