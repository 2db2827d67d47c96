"""Readers of raw pages, stored fragments, text lines and HTML pages; writers of fragments and documents."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.schema import FRAGMENT, RAW_PAGE


def read_raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """RAW_PAGE rows from JSON lines; broken lines are dropped."""
    return spark.read.schema(RAW_PAGE).option("mode", "DROPMALFORMED").json(path)


def page_range(pages: DataFrame, start: int = 1, end: int | None = None) -> DataFrame:
    """Pages start to end, both included, counted from 1; the condition reaches the scan."""
    if start < 1 or (end is not None and end < start):
        raise ValueError(f"no page range: {start} to {end}")
    kept = pages.where(F.col("page_number") >= start)
    return kept if end is None else kept.where(F.col("page_number") <= end)


#: Folders that a sink's documents are dealt to by a hash, so that their number doesn't grow with the documents.
BUCKETS = 64


def bucket_of(doc_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("long")), F.lit(buckets)).cast("int")


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """rows brought together by columns for a sink, in as many tasks as their size asks for: Spark cuts what is large and joins what is small, so files have one size however many rows a value of `by` has."""
    return rows.hint("rebalance", *[F.col(c) for c in by])


def read_fragments(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Fragments in files that write_fragments() made; files that are torn count as absent. Files of a streaming.store.Store are read by it."""
    reader = spark.read.schema(FRAGMENT).option("recursiveFileLookup", "true")
    reader = reader.option("mode", "DROPMALFORMED") if fmt == "json" else reader.option("ignoreCorruptFiles", "true")
    return reader.format(fmt).load(path).where("doc_id is not null and page_number is not null")


def write_fragments(fragments: DataFrame, path: str, fmt: str = "parquet", buckets: int = BUCKETS) -> None:
    """Fragments as files by buckets of documents, in place of those there; the committer makes the set appear whole."""
    d = fragments.withColumn("bucket", bucket_of(F.col("doc_id"), buckets))
    dealt(d, "bucket").write.mode("overwrite").partitionBy("bucket").format(fmt).save(path)


def write_documents(documents: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """(doc_id, content) as Parquet by buckets of documents; Spark's committer makes the set appear whole."""
    d = documents.select("doc_id", "content").withColumn("bucket", bucket_of(F.col("doc_id"), buckets))
    dealt(d, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """(name, size) of files (name, content binary), each written below folder so that it appears whole; one that is there is replaced.

    folder: a mounted one that all executors and readers share. Null and empty contents make no file. Nothing is written before the result is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                if not (body := content.as_py()):
                    continue
                to = Path(folder, name)
                to.parent.mkdir(parents=True, exist_ok=True)
                handle, part = tempfile.mkstemp(prefix=f".{to.name}.", dir=to.parent)
                with os.fdopen(handle, "wb") as f:
                    f.write(body)
                os.replace(part, to)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(body)], pa.int64())], ["name", "size"])

    return files.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "name string, size long")


def write_document_files(documents: DataFrame, folder: str, extension: str, buckets: int = BUCKETS) -> DataFrame:
    """write_files() of (doc_id, content): a file for each document, in folders by bucket."""
    name = F.concat_ws("/", bucket_of(F.col("doc_id"), buckets).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(f".{extension}")))
    return write_files(documents.select(name.alias("name"), "content"), folder)


def write_images(images: DataFrame, folder: str) -> DataFrame:
    """write_files() of images (doc_id, page_number, image_no, content), by the names that extraction gives to a page's images, counted from 1."""
    name = F.format_string("%d/image_%04d_%04d.png", F.col("doc_id").cast("long"), F.col("page_number").cast("int"), F.col("image_no").cast("int"))
    return write_files(images.select(name.alias("name"), "content"), folder)


def lines(docs: DataFrame, per_page: int = 40) -> DataFrame:
    """(doc_id, page_number, line_no, line) of docs (doc_id, text): lines that aren't empty, so many to a page, numbered from 0 in the document."""
    split = docs.select("doc_id", F.posexplode(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x != "")).alias("line_no", "line"))
    return split.select("doc_id", (F.floor(F.col("line_no") / per_page) + 1).cast("int").alias("page_number"), "line_no", "line")


ANCHOR = """(?is)<a\\s[^>]*?href\\s*=\\s*["']([^"']*)["'][^>]*>(.*?)</a>"""


def html_links(html: Column) -> Column:
    """array<struct<href, text>> of an HTML page's anchors with a target; tags within their text dropped."""
    hrefs, texts = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)), F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2))
    pairs = F.zip_with(hrefs, texts, lambda h, t: F.struct(h.alias("href"), F.trim(F.regexp_replace(t, "<[^>]*>", "")).alias("text")))
    return F.filter(pairs, lambda p: p["href"] != "")
