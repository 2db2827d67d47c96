"""Queries over what keeps state: stores of batches, documents that grow by a stream, what is due, settings, and captions by a model of the caller's."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators import captions
from pagewright.operators.pages import block
from pagewright.plans.inputs import SQL_LINES, fragments, shared_folder, table
from pagewright.schema import FRAGMENT
from pagewright.streaming import incremental
from pagewright.streaming.documents import PROVIDER, Documents
from pagewright.streaming.store import Store

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH {SQL_LINES}, P AS (SELECT DISTINCT doc_id, page_number AS p FROM L)
SELECT doc_id, p AS page_number, CASE WHEN p > 1 AND p // 2 = (p - 1) // 2 THEN '' ELSE 'Chapter ' || (p // 2)::VARCHAR || ' · ' END || p::VARCHAR AS margin FROM P""")
def q_growing_documents(spark, d):
    """Margins of all pages of documents that grew by a stream in two batches, pages of each in no order: a head is hidden where the page before shows it."""
    base, half = shared_folder(spark), F.pmod(F.xxhash64("doc_id", "page_number"), F.lit(2))
    # made once; the second half is moved in when the first has been taken
    fragments(spark, d).withColumn("half", half).write.partitionBy("half").parquet(f"{base}/made")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{base}/in"))
    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        docs = Documents(spark, f"{base}/documents", "txt")
        for n in (0, 1):
            if fs.exists(path(f"{base}/made/half={n}")):
                fs.rename(path(f"{base}/made/half={n}"), path(f"{base}/in/{n}"))
            docs.take(spark.readStream.schema(FRAGMENT).option("recursiveFileLookup", "true").parquet(f"{base}/in"), f"{base}/check").awaitTermination()
    finally:
        spark.conf.set(PROVIDER[0], before)
    return docs.references.read().select("doc_id", "page_number", F.array_join("margin", " · ").alias("margin"))


@query(f"""WITH {SQL_LINES}, P AS (SELECT DISTINCT doc_id, page_number FROM L)
SELECT doc_id, page_number, CASE WHEN (doc_id + page_number) % 3 = 0 THEN 'second' ELSE 'first' END AS version FROM P WHERE doc_id % 5 <> 4""")
def q_store_versions(spark, d):
    """Pages stored twice, a third of them anew in a later batch, which is tried twice; then each fifth document is taken out by a rewrite."""
    store = Store(spark, f"{shared_folder(spark)}/store")
    version = lambda d, v: d.withColumn("margin", F.array(F.lit(v)))
    pages = fragments(spark, d)
    again = version(pages.where((F.col("doc_id") + F.col("page_number")) % 3 == 0), "second")
    store.append(version(pages, "first"), "one")
    store.append(again, "two")
    store.append(version(pages, "never"), "two")
    store.rewrite(lambda all_: all_.where("doc_id % 5 <> 4"))
    return store.read().select("doc_id", "page_number", F.get("margin", F.lit(0)).alias("version"))


@query("""
WITH p AS (SELECT conv_id AS doc_id, turn FROM conversations), s AS (SELECT doc_id, count(DISTINCT turn) AS n, count(DISTINCT turn) FILTER (turn % 4 = 3 OR doc_id % 7 = 0) AS new FROM p GROUP BY 1)
SELECT doc_id FROM s WHERE new > 0 AND (n = new OR n // 3 > (n - new) // 3)""")
def q_due(spark, d):
    """Documents whose rendering is due, each third page: turns stand for pages, each fourth of which came last; each seventh document has come whole."""
    stored = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"))
    return incremental.due(stored, stored.where("page_number % 4 = 3 or doc_id % 7 = 0"), 3)


@query(f"""WITH {SQL_LINES}, P AS (SELECT DISTINCT doc_id, page_number FROM L), longest AS (SELECT min(doc_id) AS doc_id FROM (SELECT doc_id, max(page_number) AS n FROM P GROUP BY 1 QUALIFY n = max(n) OVER ()))
SELECT doc_id, page_number FROM P WHERE NOT (doc_id = (SELECT doc_id FROM longest) AND page_number BETWEEN 2 AND 5)""")
def q_restart(spark, d):
    """What is left of all pages when pages 2 to 5 of the longest document are to be made anew."""
    pages = fragments(spark, d)
    longest = pages.groupBy("doc_id").agg(F.max("page_number").alias("n")).orderBy(F.desc("n"), "doc_id").first()
    return incremental.restart(pages, longest.doc_id if longest else -1, 2, 5).select("doc_id", "page_number")


def _state(spark, d) -> DataFrame:
    """(doc_id, path, size, mtime, settings): as if documents were files, each third begun with captions."""
    docs = table(spark, d, "documents")
    settings = F.when(F.col("doc_id") % 3 == 0, "captions").when(F.col("doc_id") % 3 == 1, "plain")
    return docs.select("doc_id", F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").cast("long").alias("size"), F.timestamp_seconds(F.col("doc_id")).alias("mtime"), settings.alias("settings"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'captions' END AS was, 'plain' AS now FROM documents WHERE doc_id % 3 <> 1""")
def q_changed_settings(spark, d):
    """Documents begun with other settings, or with none that are known."""
    return incremental.changed_settings(_state(spark, d), "plain")


@query("""SELECT doc_id, '/' || source || '/' || doc_id::VARCHAR AS path, n_chars::BIGINT AS size FROM documents""")
def q_identity(spark, d):
    """Documents held against the state of half of them: all are the files they were, a null path or size among them."""
    state = _state(spark, d)
    return incremental.check_identity(state.drop("settings"), state.where("doc_id % 2 = 0")).select("doc_id", "path", "size")


def digests():
    """A model that tells the sum of an image's bytes, in place of one that sees."""
    return lambda contents: [hashlib.sha256(c).hexdigest()[:12] for c in contents]


@query("""SELECT doc_id, CASE WHEN length(text) > 0 THEN substr(sha256(text), 1, 12) ELSE '' END AS alt, CASE WHEN length(text) > 0 THEN substr(sha256('2' || text), 1, 12) END AS caption FROM documents""")
def q_captions(spark, d):
    """Captions by a model that is loaded once a process, put on an image and a placeholder of each document; what is empty isn't shown to it."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("first"), F.when(F.length("text") > 0, F.concat(F.lit("2"), "text")).cast("binary").alias("second"))
    both = F.array(*[F.struct(F.lit(n).alias("image_no"), F.col(c).alias("content")) for n, c in ((1, "first"), (2, "second"))])
    images = docs.select("doc_id", F.lit(1).alias("page_number"), F.explode(both).alias("x")).select("doc_id", "page_number", "x.*")
    made = captions.caption_images(images, captions.once_a_process("digests", digests))
    blocks = F.array(block("p", text=F.lit("t")), block("img", src=F.lit("a.png"), alt=F.lit("")), block("img_placeholder"))
    none = F.array().cast("array<string>")
    f = captions.with_captions(docs.select("doc_id", F.lit(1).alias("page_number"), none.alias("margin"), blocks.alias("blocks"), none.alias("callout")), made)
    return f.select("doc_id", F.get("blocks", F.lit(1))["alt"].alias("alt"), F.get("blocks", F.lit(2))["caption"].alias("caption"))
