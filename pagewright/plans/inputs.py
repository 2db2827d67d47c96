"""Inputs of the queries: pages made of the documents' lines, with features that documents lack put in by integer arithmetic.

Spark and SQL make the same. Eleven kinds of lines (doc_id * 7 + line_no, modulo 11): 0 a bullet, 1 a numbered item, 2 a URL, 3 a heading
with a page number, 4 a hyphen wrap, 5 control and private-use characters, 6 digits, 7 Markdown, 8 a bullet within; others as they are.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions.steps import bind, once
from pagewright.operators.pages import block
from pagewright.sources.readers import lines

PER_PAGE = 8


#: Tables whose rows are work, and the keys by which they are dealt to tasks.
KEYS = {"documents": "doc_id", "pages": "page_id", "part": "p_partkey"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of KEYS is dealt to tasks by its key.

    A file is read by as many tasks as it has row groups, often by one, which would then do all of a query's work. The columns that a query reads are
    shuffled once, as they are stored; what groups by that key and more finds its rows together, and shuffles nothing. The number is given, as Spark would go by
    bytes, and join what is small to read but long to work on.
    """
    d = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in KEYS:
        return d
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return d.repartition(tasks, KEYS[name])


def shared_folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, deleted when the driver ends; in a local one only where the master is local and none is named."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.gettempdir()
    where = f"{base.rstrip('/')}/pagewright-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return where


def _kind(n: Column) -> Column:
    return ((F.col("doc_id") * 7 + n) % 11).cast("int")


def _text(k: Column, line: Column, n: Column) -> Column:
    s = lambda c: c.cast("string")
    return (
        F.when(k == 0, F.concat(F.lit("► "), line))
        .when(k == 1, F.concat(s(n % 20 + 1), F.lit(". "), line))
        .when(k == 2, F.concat(F.lit("see https://ex.org/p"), s(F.col("doc_id")), F.lit("?a=1&b=2, ok "), line))
        .when(k == 3, F.concat(F.lit("Section "), s(n % 9), F.lit(" of part")))
        .when(k == 4, F.concat(F.lit("bro- ken- up "), line))
        .when(k == 5, F.concat(F.lit("\x01"), line))
        .when(k == 6, F.concat(F.lit("12 345 6"), s(n), F.lit(" ab")))
        .when(k == 7, F.concat(F.lit("# "), line))
        .when(k == 8, F.concat(F.lit("a • b "), line))
        .otherwise(line)
    )


def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_number, line_no, k, text)."""
    d = lines(table(spark, sf_dir, "documents"), PER_PAGE).withColumn("k", _kind(F.col("line_no")))
    return d.withColumn("text", _text(F.col("k"), F.col("line"), F.col("line_no"))).drop("line")


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_number, lines): injected() as a row a page, its lines (line_no, k, text) in order.

    A document's row is cut into pages where it is: lines as rows were sorted by page, and written to buffers twice, to be put together again.
    """
    own = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x != "")
    d = once(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", own)
    last = F.size("text") - 1
    page = lambda p: F.transform(F.sequence(p * PER_PAGE, F.least(p * PER_PAGE + PER_PAGE - 1, last)), lambda n: F.get("text", n))
    cut = F.transform(F.sequence(F.lit(0), F.floor(last / PER_PAGE).cast("int")), page)
    pages = d.where(last >= 0).select("doc_id", F.posexplode(cut).alias("at", "lines"))

    def line(x: Column, i: Column) -> Column:
        n = F.col("at") * PER_PAGE + i
        return F.struct(n.alias("line_no"), _kind(n).alias("k"), _text(_kind(n), x, n).alias("text"))

    return once(pages, "lines", F.transform("lines", line)).select("doc_id", (F.col("at") + 1).alias("page_number"), "lines")


SQL_LINES = f"""
L0 AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS l FROM documents),
L1 AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l)))::INT AS line_no FROM L0),
L2 AS (SELECT *, (line_no // {PER_PAGE} + 1)::INT AS page_number, ((doc_id * 7 + line_no) % 11)::INT AS k FROM L1),
L AS (SELECT doc_id, page_number, line_no, k, CASE k
  WHEN 0 THEN '► ' || line
  WHEN 1 THEN (line_no % 20 + 1)::VARCHAR || '. ' || line
  WHEN 2 THEN 'see https://ex.org/p' || doc_id::VARCHAR || '?a=1&b=2, ok ' || line
  WHEN 3 THEN 'Section ' || (line_no % 9)::VARCHAR || ' of part'
  WHEN 4 THEN 'bro- ken- up ' || line
  WHEN 5 THEN chr(1) || chr(57349) || line
  WHEN 6 THEN '12 345 6' || line_no::VARCHAR || ' ab'
  WHEN 7 THEN '# ' || line
  WHEN 8 THEN 'a • b ' || line
  ELSE line END AS text FROM L2)
"""


def sql_clean(x: str) -> str:
    hyphen = r"'([A-Za-zА-Яа-яЁё])-\s+([A-Za-zА-Яа-яЁё])', '\1\2', 'g'"
    return rf"regexp_replace(regexp_replace(regexp_replace({x}, '[\x{{E000}}-\x{{F8FF}}]|[\x00-\x08\x0B-\x1F]', '', 'g'), {hyphen}), {hyphen})"


def fragments(spark: SparkSession, sf_dir: str, *keep: Column) -> DataFrame:
    """Pages of blocks: k 3 a heading, k 6 code, k 0 and 1 list items, k 10 a table of a line and its number, others paragraphs; a head for each two pages, and a callout on each third; `keep`: further columns, of paged()."""
    def made(x: Column, text: Column, item: Column) -> Column:
        n = x["line_no"]
        rows = F.array(F.array(F.lit("n"), F.lit("line|")), F.array(n.cast("string"), text))
        return (
            F.when(x["k"] == 3, block("h", text=text, level=n % 2 + 2))
            .when(x["k"] == 6, block("code", text=F.concat(text, F.lit("\n  x < 1"))))
            .when(x["k"] == 10, block("table", rows=rows))
            .when(item.isNotNull(), block("li", text=item["item"], ordered=item["ordered"]))
            .otherwise(block("p", text=text))
        )

    def one(x: Column) -> Column:
        read = lambda t: F.struct(t.alias("text"), bind(T.strip(t), T.list_item).alias("item"))
        return bind(T.clean(x["text"], False), read, lambda t: made(x, t["text"], t["item"]))

    pages = once(paged(spark, sf_dir), "blocks", F.transform("lines", one))
    p = F.col("page_number")
    head = F.concat(F.lit("Chapter "), F.floor(p / 2).cast("string"))
    callout = F.when(p % 3 == 0, F.array(F.lit("Mind *this* & that"))).otherwise(F.array().cast("array<string>"))
    return pages.select("doc_id", "page_number", F.array(head, p.cast("string")).alias("margin"), "blocks", callout.alias("callout"), *keep)


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Doc <"), F.col("doc_id").cast("string"), F.lit(">")).alias("title"))


#: The same blocks in SQL, as a table B (doc_id, page_number, line_no, type, text, level, ordered).
SQL_BLOCKS = (
    SQL_LINES
    + rf""",
C AS (SELECT doc_id, page_number, line_no, k, {sql_clean("text")} AS text FROM L),
B AS (SELECT doc_id, page_number, line_no,
  CASE WHEN k = 3 THEN 'h' WHEN k = 6 THEN 'code' WHEN k = 10 THEN 'table' WHEN regexp_matches(trim(text), '^([►•‣▪●○◦]\s+\S|[0-9]{{1,2}}[.)]\s+\S)') THEN 'li' ELSE 'p' END AS type,
  CASE WHEN k = 6 THEN text || chr(10) || '  x < 1' WHEN k NOT IN (3, 10) AND regexp_matches(trim(text), '^([►•‣▪●○◦]\s+\S|[0-9]{{1,2}}[.)]\s+\S)') THEN regexp_replace(trim(text), '^([►•‣▪●○◦]|[0-9]{{1,2}}[.)])\s+', '') ELSE text END AS text,
  line_no % 2 + 2 AS level, regexp_matches(trim(text), '^[0-9]') AS ordered FROM C)
"""
)
