"""Rows kept in batches, of which a log says what counts.

    store/batches/batch=0000000007.<name>/bucket=12/...    rows, dealt to buckets by a hash of their document
    store/_log/0000000007.<name>                           one for each batch that is whole, with the batches it stands for

A batch counts as soon as its entry is in the log, which one rename puts there, and not before: what a lost writer leaves is never read. A batch
whose name is in the log is not written again, so a stream that repeats a batch repeats no row; a name has the stream's id in it, so no stream
writes over another's. To rewrite a store is to add a batch that stands for others: there is no moment at which rows are missing or twice there. Of rows with one key,
the one in the last batch counts. Files are read and written by Spark, so a store can be wherever Spark can write. What is published is whole: a file of it that
is torn, emptied or gone is an error to whoever reads the batch, whatever the session's settings.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.schema import FRAGMENT
from pagewright.sources.readers import BUCKETS, bucket_of, dealt

KEY = ("doc_id", "page_number")


class Store:
    """A store of rows of a schema (DDL) with the columns of `key`, whose first is a document's number."""

    def __init__(self, spark: SparkSession, path: str, schema: str = FRAGMENT, key: Sequence[str] = KEY, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, list(key), buckets
        jvm = spark.sparkContext._jvm
        self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        """Whether there is a file or folder, in the store's file system."""
        return self._fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))

    def _names(self, folder: str) -> dict[str, int]:
        """Names in a folder, and when each was last changed, in milliseconds; none if it isn't there."""
        where = self._path(folder)
        if not self._fs.exists(where):
            return {}
        found = {s.getPath().getName(): s.getModificationTime() for s in self._fs.listStatus(where)}
        return {n: t for n, t in sorted(found.items()) if not n.startswith(".")}

    def _entries(self, batches: Sequence[str]) -> dict[str, dict]:
        """The log's entries of batches."""
        if not batches:
            return {}
        found = self.spark.read.text([self._path("_log", b).toString() for b in batches], wholetext=True).select(F.input_file_name().alias("path"), "value").collect()
        return {r.path.rpartition("/")[2]: json.loads(r.value) for r in found}

    def _held(self, batch: str) -> dict[str, int]:
        """How many files a batch's folder holds, and their bytes."""
        found = self._fs.getContentSummary(self._path("batches", f"batch={batch}"))
        return {"files": found.getFileCount(), "bytes": found.getLength()}

    def log(self) -> list[str]:
        """All batches ever published, in their order."""
        return list(self._names("_log"))

    def batches(self) -> list[str]:
        """Those that count, in their order: what no other stands for."""
        all_ = self.log()
        gone = {old for e in self._entries([b for b in all_ if ".rewrite-" in b]).values() for old in e["replaces"]}
        return [b for b in all_ if b not in gone]

    def written(self, name: str) -> str | None:
        """The batch of this name, if it is published."""
        return next((b for b in self.log() if b.partition(".")[2] == name), None)

    def write(self, rows: DataFrame, name: str) -> str:
        """Write rows as a batch that doesn't count yet; publish() makes it count."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
            raise ValueError(f"a batch's name has letters, digits, - and _ alone: {name}")
        last = max((int(b.partition(".")[0]) for b in self.log()), default=0)
        batch = f"{last + 1:010d}.{name}"
        d = rows.select(*self._columns(), bucket_of(F.col(self.key[0]), self.buckets).alias("bucket"))
        dealt(d, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._path("batches", f"batch={batch}").toString())
        return batch

    def publish(self, batch: str, replaces: Sequence[str] = ()) -> None:
        """Put a written batch into the log, with the files it has, by one rename."""
        part, to = self._path("_log", f".{uuid.uuid4().hex}"), self._path("_log", batch)
        out = self._fs.create(part, True)
        out.write(json.dumps({"replaces": list(replaces), **self._held(batch)}).encode())
        out.close()
        if not self._fs.rename(part, to):
            raise OSError(f"can't publish {to.toString()}")

    def append(self, rows: DataFrame, name: str) -> bool:
        """Add rows as a batch, each key once; False, and nothing done, if a batch of this name is published already."""
        if self.written(name) is not None:
            return False
        self.publish(self.write(rows, name))
        return True

    def rewrite(self, change: Callable[[DataFrame], DataFrame]) -> None:
        """Put change(the store's rows) in place of all batches that count now; batches that are published meanwhile stay."""
        old = self.batches()
        self.publish(self.write(change(self._read(old)), f"rewrite-{uuid.uuid4().hex}"), old)
        self.vacuum()

    def vacuum(self, hours: float = 24.0) -> None:
        """Delete the rows of batches that another stands for, and what writers left unpublished that many hours ago or longer."""
        published, live, old = set(self.log()), set(self.batches()), (time.time() - hours * 3600) * 1000
        for folder, changed in self._names("batches").items():
            batch = folder.removeprefix("batch=")
            if batch not in live and (batch in published or changed < old):
                self._fs.delete(self._path("batches", folder), True)

    def _columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def _files(self, batches: Sequence[str], buckets: Sequence[int] | None = None) -> DataFrame:
        """Rows of batches with the batch and bucket they are in; an error if a batch isn't as it was published, or a file can't be read."""
        if not batches:
            return self.spark.createDataFrame([], f"{self.schema}, batch string, bucket int")
        for batch, entry in self._entries(batches).items():
            # Spark passes over files that are gone or empty; entries of old don't tell how many there were
            if "files" in entry and (held := self._held(batch)) != (was := {n: entry[n] for n in held}):
                raise OSError(f"{self._path('batches', f'batch={batch}').toString()} isn't as it was published: {held} instead of {was}")
        paths = [self._path("batches", f"batch={b}").toString() for b in batches]
        reader = self.spark.read.schema(f"{self.schema}, batch string, bucket int").option("basePath", self._path("batches").toString())
        d = reader.option("ignoreCorruptFiles", "false").option("ignoreMissingFiles", "false").parquet(*paths)
        return d if buckets is None else d.where(F.col("bucket").isin(list(buckets)))

    def batch(self, batch: str) -> DataFrame:
        """The rows of one batch."""
        return self._files([batch]).select(*self._columns())

    def _read(self, batches: Sequence[str], buckets: Sequence[int] | None = None) -> DataFrame:
        all_ = self._files(batches, buckets)
        if len(batches) > 1:
            # keys alone are read to see which rows a later batch has anew; rows themselves aren't shuffled for it
            held = all_.select(*self.key, "batch").groupBy(*self.key).agg(F.array_sort(F.collect_set("batch")).alias("b")).where(F.size("b") > 1)
            stale = held.select(*self.key, F.explode(F.slice("b", F.lit(1), F.size("b") - 1)).alias("batch"))
            all_ = all_.join(stale, [*self.key, "batch"], "left_anti")
        return all_.select(*self._columns())

    def read(self, documents: DataFrame | None = None) -> DataFrame:
        """Each key's row in the last batch that has it; of these documents (doc_id) alone, if given, for which only their buckets are read."""
        if documents is None:
            return self._read(self.batches())
        own = documents.select(F.col(self.key[0])).distinct()
        buckets = [r.b for r in own.select(bucket_of(F.col(self.key[0]), self.buckets).alias("b")).distinct().collect()]  # as many as there are buckets
        return self._read(self.batches(), buckets).join(own, self.key[0], "left_semi")


def one_of_each(rows: DataFrame, key: Sequence[str], by: Column) -> DataFrame:
    """Of rows with one key the one of the least `by`, with which it doesn't depend on the run."""
    names = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*names), by).alias("_row"))
    return first.select(*key, *[F.col(f"_row.{c}").alias(c) for c in names]).select(*rows.columns)
