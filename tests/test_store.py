"""The store of batches, and streams into it: crashes between any two steps, fresh checkpoints, several streams, late pages."""

import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import pages as page_ops
from pagewright.operators import render
from pagewright.plans import inputs
from pagewright.schema import FRAGMENT, RAW_PAGE
from pagewright.sources import readers
from pagewright.streaming import incremental
from pagewright.streaming import store as store_module
from pagewright.streaming.documents import PROVIDER, Documents
from pagewright.streaming.store import Store
from tests.conftest import DATA

STEPS = ("write", "publish", "vacuum")


class Crash(Exception):
    pass


def rows(spark, *keys):
    return spark.createDataFrame([(d, p, [f"{v}"], [], []) for d, p, v in keys], FRAGMENT)


def held(store):
    return sorted((r.doc_id, r.page_number, r.margin[0]) for r in store.read().collect())


def raw(doc_id, number, text, head=None):
    def block(t, y):
        return (0, [50.0, y, 300.0, y + 10], [([(t, 10.0, "Serif", 0, [50.0, y, 300.0, y + 10])],)])

    return (doc_id, number, 600.0, 800.0, [block(text, 100.0), *([block(head, 10.0)] if head else [])], [], [], [], [])


def put(spark, folder, *pages):
    spark.createDataFrame(list(pages), RAW_PAGE).coalesce(1).write.mode("append").json(str(folder))


def plain(pages):
    """Fragments of raw pages without the judgement of extraction, which takes long to plan: a block is a paragraph, one in the head a margin."""
    text = lambda b: b["lines"][0]["spans"][0]["text"]
    margin = F.transform(F.filter("blocks", lambda b: b["bbox"][1] < 50), text)
    blocks = F.transform(F.filter("blocks", lambda b: b["bbox"][1] >= 50), lambda b: page_ops.block("p", text=text(b)))
    return pages.select("doc_id", "page_number", margin.alias("margin"), blocks.alias("blocks"), F.array().cast("array<string>").alias("callout"))


def take(docs, spark, folder, checkpoint, after=None, **how):
    docs.take(plain(incremental.raw_stream(spark, str(folder))), str(checkpoint), after, **how).awaitTermination()


def test_the_last_batch_counts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.read().count() == 0 and store.batches() == []
    assert store.append(rows(spark, (1, 1, "a"), (1, 2, "a"), (2, 1, "a")), "one")
    assert store.append(rows(spark, (1, 2, "b"), (3, 1, "b")), "two")
    assert not store.append(rows(spark, (9, 9, "c")), "two")
    assert held(store) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (3, 1, "b")]
    assert store.append(rows(spark), "none") and len(held(store)) == 4
    some = store.read(spark.createDataFrame([(1,), (7,), (1,)], "doc_id long"))
    assert sorted((r.doc_id, r.margin[0]) for r in some.collect()) == [(1, "a"), (1, "b")]
    with pytest.raises(ValueError):
        store.append(rows(spark), "a/b")


def test_a_read_of_documents_opens_their_buckets_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.append(rows(spark, *[(d, 1, "a") for d in range(200)]), "one")
    files = lambda d: len(d.inputFiles())
    own = store._files(store.batches(), [3])
    assert 0 < files(own.where("bucket = 3")) and own.select("bucket").distinct().count() == 1
    plan = store.read(spark.createDataFrame([(5,)], "doc_id long"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters")[1][:80]


@pytest.mark.parametrize("step", STEPS)
def test_a_rewrite_that_stops_anywhere_loses_nothing(spark, tmp_path, monkeypatch, step):
    store = Store(spark, str(tmp_path / "s"))
    store.append(rows(spark, (1, 1, "a"), (2, 1, "a")), "one")
    store.append(rows(spark, (1, 1, "b")), "two")
    before, after = [(1, 1, "b"), (2, 1, "a")], [(1, 1, "b")]
    for late in (False, True):  # stopped before the step, and after it
        own = getattr(Store, step)

        def stop(self, *args, own=own, late=late, **more):
            if late:
                own(self, *args, **more)
            raise Crash

        with monkeypatch.context() as m:
            m.setattr(Store, step, stop)
            with pytest.raises(Crash):
                store.rewrite(lambda f: f.where("doc_id = 1"))
        found = held(Store(spark, store.path))
        assert found == (before if step == "write" or (step == "publish" and not late) else after)
    store.append(rows(spark, (5, 1, "n")), "three")
    store.rewrite(lambda f: f.where("doc_id <> 2"))
    assert held(store) == [(1, 1, "b"), (5, 1, "n")]
    store.vacuum(0)
    assert len(store.batches()) == len(list((tmp_path / "s" / "batches").iterdir())) == 1


def test_what_is_published_during_a_rewrite_stays(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.append(rows(spark, (1, 1, "a")), "one")

    def change(d):
        Store(spark, store.path).append(rows(spark, (2, 1, "new")), "meanwhile")
        return d

    store.rewrite(change)
    assert held(store) == [(1, 1, "a"), (2, 1, "new")]


def test_two_streams_and_a_fresh_checkpoint(spark, tmp_path):
    store, seen = Store(spark, str(tmp_path / "s")), []

    def run(name, checkpoint):
        incremental.stream_fragments(spark, str(tmp_path / name), store, str(tmp_path / checkpoint), lambda d, n: seen.append(sorted((r.doc_id, r.page_number) for r in d.collect())), plain).awaitTermination()

    keys = lambda: sorted((r.doc_id, r.page_number) for r in store.read().collect())
    put(spark, tmp_path / "a", raw(1, 1, "one"), raw(1, 1, "one"))
    put(spark, tmp_path / "b", raw(4, 1, "four"))
    run("a", "check-a")
    run("b", "check-b")
    assert keys() == [(1, 1), (4, 1)]
    put(spark, tmp_path / "a", raw(1, 2, "two"))
    run("a", "fresh")  # takes both files of a in anew
    assert keys() == [(1, 1), (1, 2), (4, 1)] and seen == [[(1, 1)], [(4, 1)], [(1, 1), (1, 2)]]


@pytest.mark.parametrize("at", ["before the write", "after the write", "after the entry", "in what follows"])
def test_a_stream_that_stops_repeats_and_loses_nothing(spark, tmp_path, monkeypatch, at):
    store, seen = Store(spark, str(tmp_path / "s")), []

    def run(after=None):
        incremental.stream_fragments(spark, str(tmp_path / "in"), store, str(tmp_path / "check"), after, plain).awaitTermination()

    put(spark, tmp_path / "in", raw(1, 1, "one"))
    run()
    put(spark, tmp_path / "in", raw(1, 2, "two"), raw(2, 1, "other"))
    step = {"before the write": "write", "after the write": "publish", "after the entry": "publish", "in what follows": None}[at]

    def stop(self, *args, own=step and getattr(Store, step), **more):
        if at == "after the entry":
            own(self, *args, **more)
        raise Crash

    def follow(*_):
        raise Crash

    with monkeypatch.context() as m:
        if step:
            m.setattr(Store, step, stop)
        with pytest.raises(Exception):
            run(None if step else follow)
    run(lambda d, n: seen.append(d.count()))
    assert sorted((r.doc_id, r.page_number) for r in store.read().collect()) == [(1, 1), (1, 2), (2, 1)]
    assert seen == [2] and len(store.batches()) == 2


def test_sinks_have_as_many_tasks_as_data(spark, tmp_path):
    """A bucket that holds most of the rows is written by several tasks."""
    d = spark.range(40_000).select(F.lit(7).cast("long").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("content")).repartition(16)
    names = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "200k")
    try:
        readers.write_documents(d, str(tmp_path / "docs"))
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert len(list((tmp_path / "docs").glob("bucket=*/*.parquet"))) > 4


def test_one_of_each(spark):
    d = spark.createDataFrame([(1, 1, "b"), (1, 1, "a"), (2, 1, None)], "doc_id long, page_number int, x string")
    got = store_module.one_of_each(d, ["doc_id", "page_number"], F.col("x"))
    assert got.columns == d.columns and sorted(map(tuple, got.collect())) == [(1, 1, "a"), (2, 1, None)]


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    yield
    spark.conf.set(PROVIDER[0], before)


def whole(spark, pages, titles, fmt):
    return {r.doc_id: r.content for r in render.render_documents(plain(spark.createDataFrame(pages, RAW_PAGE)), titles, fmt).collect()}


@pytest.mark.parametrize("fmt", ["html", "md", "txt"])
def test_documents_grow_to_what_they_are_at_once(spark, tmp_path, rocks, fmt):
    """Pages in any order over several batches, some twice, some changed: the same as all at once, heads hidden by the page before."""
    titles = spark.createDataFrame([(1, "One"), (2, "Two")], "doc_id long, title string")
    heads = ["Chapter 1", "Chapter 1", "Chapter 2", "Chapter 2", "Chapter 2", "12"]
    pages = [raw(d, p, f"text {d} {p}", heads[(p + d) % 6]) for d in (1, 2) for p in range(1, 9)]
    order = random.Random(5).sample(pages, len(pages))
    docs, seen = Documents(spark, str(tmp_path / "d"), fmt), []
    for k, own in enumerate((order[:5], order[5:7], [*order[7:], order[0]], [order[2]])):
        put(spark, tmp_path / "in", *own)
        take(docs, spark, tmp_path / "in", tmp_path / "check", lambda d, n: seen.append(sorted(r.doc_id for r in d.collect())), every=4)
    got = {r.doc_id: r.content for r in docs.content(titles).collect()}
    assert got == whole(spark, pages, titles, fmt)
    assert seen[0] == [1, 2] and seen[3] == [] and len(seen) == 4
    one = docs.content(titles, spark.createDataFrame([(2,)], "doc_id long"))
    assert {r.doc_id: r.content for r in one.collect()} == {2: got[2]}
    # a body is stored once
    assert docs.bodies._files(docs.bodies.batches()).count() == len(pages)
    # a changed page, by a fresh checkpoint that begins with what is stored
    changed = [raw(1, 3, "another text", "Chapter 9")]
    put(spark, tmp_path / "more", *changed)
    take(docs, spark, tmp_path / "more", tmp_path / "fresh", every=4)
    now = [p for p in pages if p[:2] != (1, 3)] + changed
    assert {r.doc_id: r.content for r in docs.content(titles).collect()} == whole(spark, now, titles, fmt)


def test_a_batch_reads_nothing_of_the_stores(spark, tmp_path, rocks, monkeypatch):
    docs = Documents(spark, str(tmp_path / "d"), "txt")
    put(spark, tmp_path / "in", raw(1, 2, "two", "Head"))
    take(docs, spark, tmp_path / "in", tmp_path / "check")
    put(spark, tmp_path / "in", raw(1, 1, "one", "Head"))
    with monkeypatch.context() as m:
        m.setattr(Store, "_files", lambda *_: pytest.fail("reads rows of a store"))
        take(docs, spark, tmp_path / "in", tmp_path / "check")
    # the page that came, and the one after it, whose head is hidden now
    last = docs.references.batch(docs.references.batches()[-1])
    assert sorted((r.page_number, r.margin) for r in last.collect()) == [(1, ["Head"]), (2, [])]
    assert docs.bodies.batch(docs.bodies.batches()[-1]).count() == 1


@pytest.mark.parametrize("step", ["bodies", "references", "after"])
def test_growing_documents_survive_a_stop(spark, tmp_path, rocks, monkeypatch, step):
    titles = spark.createDataFrame([(1, "One")], "doc_id long, title string")
    pages = [raw(1, p, f"text {p}", "Head") for p in (1, 2, 3)]
    docs = Documents(spark, str(tmp_path / "d"), "md")
    put(spark, tmp_path / "in", pages[0], pages[2])
    take(docs, spark, tmp_path / "in", tmp_path / "check")
    put(spark, tmp_path / "in", pages[1])
    own = Store.append

    def stop(self, d, name):
        if self.path.endswith(step):
            raise Crash
        return own(self, d, name)

    def follow(*_):
        raise Crash

    with monkeypatch.context() as m:
        m.setattr(Store, "append", stop)
        with pytest.raises(Exception):
            take(docs, spark, tmp_path / "in", tmp_path / "check", follow)
    take(docs, spark, tmp_path / "in", tmp_path / "check")
    assert {r.doc_id: r.content for r in docs.content(titles).collect()} == whole(spark, pages, titles, "md")


def test_raw_pages_to_documents(spark, tmp_path, rocks):
    """The whole way, extraction included."""
    put(spark, tmp_path / "in", raw(1, 1, "one", "Head"), raw(1, 2, "two", "Head"))
    docs = Documents(spark, str(tmp_path / "d"), "txt")
    docs.stream(str(tmp_path / "in"), str(tmp_path / "check")).awaitTermination()
    assert docs.content(spark.createDataFrame([(1, "One")], "doc_id long, title string")).first().content == "One\n===\n\n[Head]\n\none\n\n----------\n\ntwo\n"


def test_heads_of_whole_documents(spark, tmp_path, rocks):
    """Margins in the references equal those that hide_running_heads() makes of all pages at once."""
    f = inputs.fragments(spark, DATA).where("doc_id < 40")
    want = {(r.doc_id, r.page_number): r.margin_display for r in render.hide_running_heads(f).collect()}
    bodies = render.render_bodies(f, "txt").withColumn("body_hash", F.sha2("body", 256))
    from pagewright.streaming.documents import CHANGE, Pages

    bodies.withColumn("k", F.pmod(F.xxhash64("doc_id", "page_number"), F.lit(4))).write.partitionBy("k").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).drop("k").schema
    got = {}

    def batch(d, _):
        got.update({(r.doc_id, r.page_number): r.margin for r in d.collect()})

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    changes = stream.groupBy("doc_id").transformWithStateInPandas(Pages(), CHANGE, "update", "none")
    changes.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert got == want and any(len(m) < 2 for m in want.values())
