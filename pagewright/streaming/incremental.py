"""Extraction that goes on where it stopped: a store of fragments is the state, an anti-join the resumption, a file stream the live form."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.operators import pages as page_ops
from pagewright.operators import render
from pagewright.schema import RAW_PAGE
from pagewright.streaming.store import Store, one_of_each

KEY = ["doc_id", "page_number"]
#: Fixed value: a document is rendered anew after its first page and then after so many.
EVERY = 10
STATE = "doc_id long, path string, size long, mtime timestamp, settings string"


def remaining(pages: DataFrame, fragments: DataFrame) -> DataFrame:
    """Pages that no fragment stands for."""
    return pages.join(fragments.select(*KEY).distinct(), KEY, "left_anti")


def check_identity(documents: DataFrame, state: DataFrame) -> DataFrame:
    """documents (doc_id, path, size, mtime), as they are; an error where state has another path, size or time for one of them."""
    names = ("path", "size", "mtime")
    old = state.select("doc_id", F.lit(True).alias("_known"), *[F.col(c).alias(f"_{c}") for c in names])
    same = F.col("_known").isNull()
    both = F.lit(True)
    for c in names:
        both = both & F.col(f"_{c}").eqNullSafe(F.col(c))
    error = F.raise_error(F.concat(F.lit("the state belongs to another file, of another path, size or time: "), F.coalesce("path", F.lit("?")))).cast("string")
    return documents.join(old, "doc_id", "left").withColumn("path", F.when(same | both, F.col("path")).otherwise(error)).select(*documents.columns)


def changed_settings(state: DataFrame, settings: str) -> DataFrame:
    """(doc_id, was, now) of documents begun with other settings: stored pages keep what they hold; restart() makes them anew."""
    return state.where(~F.col("settings").eqNullSafe(F.lit(settings))).select("doc_id", F.col("settings").alias("was"), F.lit(settings).alias("now"))


def restart(fragments: DataFrame, doc_id: int, start: int, end: int) -> DataFrame:
    """Fragments without those of a document's pages start to end."""
    return fragments.where(~((F.col("doc_id") == doc_id) & F.col("page_number").between(start, end)))


def finished(fragments: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents (doc_id, page_count) of which all pages are stored; their state may go."""
    done = fragments.where("page_number >= 1").groupBy("doc_id").agg(F.countDistinct("page_number").alias("done"))
    return documents.join(done, "doc_id").where(F.col("done") == F.col("page_count")).select("doc_id")


def clean_up(store: Store, documents: DataFrame) -> None:
    """Delete the fragments of documents (doc_id, page_count) that are stored whole; those of others stay, to go on with."""
    store.rewrite(lambda f: f.join(finished(f, documents), "doc_id", "left_anti"))


def extract_remaining(pages: DataFrame, store: Store) -> int:
    """Extract the pages the store lacks and add them, as a batch of their own; how many there were."""
    batch = store.write(page_ops.extract(remaining(pages, store.read())), f"run-{uuid.uuid4().hex}")
    store.publish(batch)
    return store.batch(batch).count()  # by the files' footers


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that a checkpoint belongs to, which it keeps over restarts and a fresh checkpoint doesn't have."""
    rows = spark.read.text(f"{checkpoint.rstrip('/')}/metadata").collect()
    return json.loads("".join(r.value for r in rows))["id"]


def raw_stream(spark: SparkSession, incoming: str) -> DataFrame:
    """Raw pages of JSON files as they come; a broken line stops the stream, which takes its batch again when it is started anew."""
    reader = spark.readStream.schema(RAW_PAGE).option("mode", "FAILFAST")
    return reader.option("ignoreCorruptFiles", "false").option("ignoreMissingFiles", "false").json(incoming)


def stream_fragments(
    spark: SparkSession, incoming: str, store: Store, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None, extract: Callable[[DataFrame], DataFrame] = page_ops.extract
) -> StreamingQuery:
    """Fragments of raw-page files as they come; `after` sees each batch's fragments, as to render its documents anew. extract: makes fragments of raw pages.

    A batch is named by the stream and its number: one that is done again after a crash is not written twice, and `after` sees it again. Any number of
    streams may write to one store. Pages may come in any order: running heads and order are made when documents are read. Of a page
    that comes twice in a batch, the version with the least hash counts; of one in several batches, that of the last.
    """

    def batch(df: DataFrame, number: int) -> None:
        name = f"{stream_id(df.sparkSession, checkpoint)}-{number}"
        store.append(extract(one_of_each(df, KEY, F.xxhash64(*df.columns))), name)
        if after is not None:
            after(store.batch(store.written(name)), number)

    return raw_stream(spark, incoming).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def due(stored_: DataFrame, made: DataFrame, every: int = EVERY) -> DataFrame:
    """(doc_id) of documents whose rendering is due, where `made` is the part of the stored pages that came last: with their first page, and whenever a count of pages divisible by `every` is reached or passed."""
    now = stored_.select(*KEY).distinct().join(made.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("now"))
    new = made.select(*KEY).distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("new"))
    before = F.col("now") - F.col("new")
    return now.join(new, "doc_id").where((before == 0) | (F.floor(F.col("now") / every) > F.floor(before / every))).select("doc_id")


def render_changed(store: Store, titles: DataFrame, fmt: str, publish: Callable[[DataFrame], None], every: int = 1) -> Callable[[DataFrame, int], None]:
    """For stream_fragments: render the whole documents that a batch touched, all of them or, if every is above 1, those due(). Reads these documents' buckets; streaming.documents reads less."""

    def run(made: DataFrame, _: int) -> None:
        own = store.read(made.select("doc_id"))
        if every > 1:
            own = own.join(due(own, made, every), "doc_id", "left_semi")
        publish(render.render_documents(own, titles, fmt))

    return run
