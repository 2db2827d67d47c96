import re

import numpy as np
from pyspark.sql import functions as F

from pagewright.llm import decontaminate as D
from tests.conftest import DATA_01

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, bench, width=10):
    windows = {}
    for i, t in bench:
        w = words(t)
        for j in range(max(min(len(w), 1), len(w) - width + 1)):
            windows.setdefault(tuple(w[j : j + width]), set()).add(i)
    lengths = {len(w) for w in windows}
    out = {}
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                if own := windows.get(tuple(w[j : j + n])):
                    hit.update(range(j, j + n))
                    items |= own
        out[d] = (len(w), len(hit), len(items), D.items_digest(items), bool(hit))
    return out


def result(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def test_suffix_array_and_search():
    rng = np.random.default_rng(1)
    for _ in range(30):
        s = np.concatenate([np.concatenate((rng.integers(1, 4, rng.integers(1, 30)), [0])) for _ in range(5)])
        t = s.astype(object)
        for m, p in enumerate(np.flatnonzero(s == 0)):
            t[p] = -100 + m
        sa = D.suffix_array(s)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: t[i:].tolist())
        fm = D.FMIndex(s, 3)
        for length in (1, 2, 4):
            p = rng.integers(1, 4, (20, length))
            lo, hi = fm.search(p)
            for q, a, b in zip(p, lo, hi):
                want = [i for i in range(len(s) - length + 1) if (s[i : i + length] == q).all()]
                assert sorted(fm.locate(np.arange(a, b)).tolist()) == want


def test_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA_01}/documents.parquet").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA_01}/benchmark.parquet").collect()]
    got = result(D.op6_benchmark_decontamination(spark, DATA_01))
    assert got == brute(docs, bench)
    assert sum(x[4] for x in got.values()) > 10


def test_edges_blocks_and_cuts(spark, monkeypatch):
    item = "one Two three four five six seven eight nine ten eleven twelve"
    bench = [(1, item), (2, "Lone"), (3, None), (4, " ,. "), (5, "é à"), (11, item), (6, "a a a a a a a a a a a")]
    docs = [(1, None), (2, ""), (3, "x one two, THREE four five six seven-eight nine ten! eleven y"), (4, "LONE lone"), (5, "é À"), (6, "É à é à é"), (7, "a " * 40 + "b"), (8, "one two three four five six seven eight nine x ten"), (9, "clean text stays"), (10, (item + " filler ") * 500)]
    spans = "doc_id long, text string, items string, spans int"
    d = spark.createDataFrame([(*x, "q", 1) for x in docs], spans).repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = brute(docs, bench)
    for limit in (10**9, 30):
        monkeypatch.setattr(D, "BLOCK_CHARS", limit)
        got = {r.doc_id: r for r in D.decontaminate(d, b, 10, cut=True).collect()}
        for i, (n, n_hit, n_items, _, _) in want.items():
            r = got[i]
            assert (r.n_words, sum(x.end - x.start for x in r.spans), len(r["items"])) == (n, n_hit, n_items), (limit, i)
        assert got[3].text == "x  y" and got[9].text == "clean text stays" and got[1].text is None and got[4].text == ""
    none = D.decontaminate(d, b.where("false"), 10)
    assert none.where(F.size("spans") > 0).count() == 0 and none.count() == len(docs)
    assert D.decontaminate(d.where("false"), b).count() == 0


def test_null_item_ids(spark, monkeypatch):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, "lone"), (3, "clean")], "doc_id long, text string")
    b = spark.createDataFrame([(None, item), (None, "lone"), (4, "lone")], "item_id long, text string")
    for limit in (10**9, 10):
        monkeypatch.setattr(D, "BLOCK_CHARS", limit)
        got = {r.doc_id: r for r in D.decontaminate(docs, b, 10, cut=True).collect()}
        assert [(got[i].text, got[i]["items"]) for i in (1, 2, 3)] == [("x  y", []), ("", [4]), ("clean", [])]


def test_long_items_in_many_blocks(spark, monkeypatch):
    """An item far longer than a piece is cut; its windows, and those across cuts, are all found."""
    rng = np.random.default_rng(6)
    long = [f"v{i}" for i in rng.integers(0, 40, 3000)]
    bench = [(1, " ".join(long)), (2, " ".join(f"u{i}" for i in range(57))), (None, "k1 k2 k3"), (3, "k1 k2 k3"), (4, None), (5, "")]
    docs = [(i, " ".join(long[at : at + 25]) + " gap") for i, at in enumerate(range(0, 2990, 47))] + [(900, "x " + " ".join(f"u{i}" for i in range(40, 57))), (901, "k1 k2 K3 k1"), (902, None), (903, " ".join(long))]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = brute(docs, [x for x in bench if x[0] is not None])
    for chars, words_ in ((10**9, 10**9), (2000, 100), (400, 7)):
        monkeypatch.setattr(D, "BLOCK_CHARS", chars)
        monkeypatch.setattr(D, "PIECE_WORDS", words_)
        blocks = D.benchmark_blocks(b, 10)
        assert len(blocks) == (1 if chars == 10**9 else blocks and len(blocks)) and (chars == 10**9 or len(blocks) > 5)
        got = {r.doc_id: (r.n_words, sum(x.end - x.start for x in r.spans), len(r["items"]), D.items_digest(r["items"]), bool(r.spans)) for r in D.decontaminate(d, b, 10).collect()}
        assert got == want, (chars, words_)


def test_a_block_on_the_driver_is_small():
    """A block of a million characters takes less than 100 MB while it is made."""
    import tracemalloc

    rng = np.random.default_rng(1)
    text = " ".join(f"w{i}" for i in rng.integers(0, 60_000, 150_000))
    tracemalloc.start()
    w = D.Windows([(1, text)], 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print(len(text), peak)
    assert len(w.groups[0][1]) > 149_000 and peak < 100_000_000
