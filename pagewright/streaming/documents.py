"""Documents that grow as their pages come: a page is rendered when it comes, and a document is a list of references to pages.

What a page looks like depends on the page before it alone, by the running heads that both show. A stateful stream keeps, for each document, its
pages' numbers and margins, so a batch gives out the pages that came and those whose margin changes by them, in whatever order they come. Bodies go into
one store by the hash of their content, references into another; nothing is read back to take a batch in, so what a batch costs doesn't grow with
the stores. A document is put together when it is asked for, from its own references and bodies.

State is kept by Spark's RocksDB provider; the session has to name it (PROVIDER) before a stream starts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pagewright.operators import pages as page_ops
from pagewright.operators import render
from pagewright.streaming.incremental import EVERY, raw_stream, stream_id
from pagewright.streaming.store import Store

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
REFERENCE = "doc_id long, page_number int, margin array<string>, own array<string>, heads array<string>, body_hash string"
BODY = "doc_id long, body_hash string, body string"
CHANGE = "doc_id long, page_number int, margin array<string>, own array<string>, heads array<string>, body_hash string, body string, due boolean"
KEPT = "own array<string>, heads array<string>, body_hash string"


class Pages(StatefulProcessor):
    """Keeps a document's pages; gives out those that changed, with the margin they show now. every: rendering is due with a document's first page and whenever a count of pages divisible by it is reached or passed."""

    def __init__(self, every: int = EVERY, quiet_ms: int | None = None):
        self.every, self.quiet = every, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", "page_number int", KEPT, self.quiet)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples(index=False):
            self.pages.updateValue((int(r.page_number),), (list(r.own), list(r.heads), r.body_hash))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = self.changes(key[0], (r for part in rows for r in part.itertuples(index=False)))
        yield pd.DataFrame(out, columns=["doc_id", "page_number", "margin", "own", "heads", "body_hash", "body", "due"])

    def changes(self, doc_id: int, rows: Iterable) -> list[tuple]:
        """Rows of CHANGE that a document's pages which came make; what is kept is brought up to date."""
        known = {k[0]: (list(v[0]), list(v[1]), v[2]) for k, v in self.pages.iterator()}
        before, bodies = len(known), {}
        came: dict[int, tuple] = {}
        for r in rows:
            new = (list(r.margin), list(r.heads), r.body_hash)
            page = int(r.page_number)
            # of versions of a page in one batch the greatest counts, so that it doesn't depend on the run
            if page not in came or (new[2], new[0]) > (came[page][2], came[page][0]):
                came[page], bodies[page] = new, r.body
        changed = {p for p, new in came.items() if known.get(p) != new}
        known |= came
        order = sorted(known)
        place = {p: i for i, p in enumerate(order)}
        shown = changed | {order[place[p] + 1] for p in changed if place[p] + 1 < len(order)}
        for p in changed:
            self.pages.updateValue((p,), known[p])
        due = bool(shown) and (before == 0 or len(order) // self.every > before // self.every)
        out = []
        for p in sorted(shown):
            own, heads, digest = known[p]
            last = known[order[place[p] - 1]][1] if place[p] else []
            out.append((doc_id, p, [m for m in own if m not in last], own, heads, digest, bodies.get(p) if p in changed else None, due))
        return out

    def close(self) -> None:
        pass


class PageRows(Pages):
    """Pages for transformWithState(): most documents have few pages in a batch, and data frames of so few rows take longer to make than the rest."""

    made = Row(*(c.split()[0] for c in CHANGE.split(", ")))

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.pages.updateValue((initialState.page_number,), (initialState.own, initialState.heads, initialState.body_hash))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        return (self.made(*x) for x in self.changes(key[0], rows))


class Documents:
    """References and bodies of documents in one format, below a folder."""

    def __init__(self, spark: SparkSession, path: str, fmt: str):
        self.spark, self.fmt = spark, fmt
        self.references = Store(spark, f"{path.rstrip('/')}/references", REFERENCE)
        self.bodies = Store(spark, f"{path.rstrip('/')}/bodies", BODY, ("doc_id", "body_hash"))

    def stream(self, incoming: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None, **how) -> StreamingQuery:
        """take() of the fragments of raw-page files as they come."""
        return self.take(page_ops.extract(raw_stream(self.spark, incoming)), checkpoint, after, **how)

    def take(self, fragments: DataFrame, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None, every: int = EVERY, quiet_ms: int | None = None) -> StreamingQuery:
        """Take a stream of fragments in. after: sees each batch's (doc_id) of documents whose rendering is due.

        A fresh checkpoint begins with the pages that are stored. A batch that is done again after a crash, wherever it was, adds nothing twice. quiet_ms: state of pages that haven't
        changed for so long goes; what comes after them later is shown as if they weren't there.
        """
        # bodies have hashes, so that a page that comes again as it was changes nothing
        parts = render.render_bodies(fragments, self.fmt).withColumn("body_hash", F.sha2("body", 256))
        # a checkpoint that has taken a batch in has its state
        fresh = self.references.batches() and not self.references.exists(f"{checkpoint.rstrip('/')}/commits/0")
        stored = self.references.read().select("doc_id", "page_number", "own", "heads", "body_hash").groupBy("doc_id") if fresh else None
        changes = parts.groupBy("doc_id").transformWithState(PageRows(every, quiet_ms), CHANGE, "update", "none" if quiet_ms is None else "processingTime", stored)

        def batch(df: DataFrame, number: int) -> None:
            name = f"{stream_id(df.sparkSession, checkpoint)}-{number}"
            df.persist()
            try:
                df.count()  # state is made by what reads the batch, and nothing else may read one that is stored already
                self.bodies.append(df.where("body is not null").select("doc_id", "body_hash", "body").dropDuplicates(["doc_id", "body_hash"]), name)
                self.references.append(df.select(*[c.split()[0] for c in REFERENCE.split(", ")]), name)
                if after is not None:
                    after(df.where("due").select("doc_id").distinct(), number)
            finally:
                df.unpersist()

        return changes.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def content(self, titles: DataFrame, documents: DataFrame | None = None) -> DataFrame:
        """(doc_id, content) of all documents or of these (doc_id), put together from their references."""
        pages = self.references.read(documents).join(self.bodies.read(documents), ["doc_id", "body_hash"])
        body = render.page_of(self.fmt, F.col("page_number"), F.col("margin"), F.col("body"))
        return render.assemble(pages.select("doc_id", "page_number", body.alias("body")), titles, self.fmt)
