import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm.minhash import near_duplicates, op4_minhash_near_dedup, sketch
from tests.conftest import DATA_01

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, k, percent=80):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    shared = defaultdict(int)
    for ids in by.values():
        for p in range(len(ids)):
            for q in range(p):
                shared[min(ids[p], ids[q]), max(ids[p], ids[q])] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA_01}/documents.parquet").collect()]
    assert result(op4_minhash_near_dedup(spark, DATA_01)) == brute(rows, 2)


def test_groups_chains_and_edges(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}é" for i in range(300)]
    base = [vocab[j] for j in rng.integers(0, 300, 120)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "two words"), (6, "TWO  words"), (7, "É x"), (8, "é x")]
    for i in range(300):  # a large group of near copies, a chain whose ends are far apart, and others
        w = list(base)
        for j in rng.integers(0, 120, rng.integers(1, 6)):
            w[j] = f"new{rng.integers(0, 9999)}"
        rows.append((100 + i, " ".join(w)))
    w = [f"c{i}" for i in range(100)]
    for i in range(60):
        rows.append((1000 + i, " ".join(w)))
        w = w[3:] + [f"c{i}_{j}" for j in range(3)]
    for i in range(100):
        rows.append((2000 + i, " ".join(base[:40] + [f"u{i}_{j}" for j in range(80)])))
    rows += [(3000, "word " * 30_000), (3001, "word " * 29_000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, rep string, bucket int")
    assert result(near_duplicates(docs.repartition(5), k=2)) == brute(rows, 2)
    assert result(near_duplicates(docs, k=5)) == brute(rows, 5)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).collect() == []


@pytest.mark.parametrize("n", [1, 2, 30, 5000])
def test_sketch_estimates(n):
    rng = np.random.default_rng(n)
    a = rng.integers(0, 2**63, n, dtype=np.uint64)
    b = np.concatenate((a[: n - n // 10], rng.integers(0, 2**63, n // 10, dtype=np.uint64)))
    s = sketch(np.concatenate((a, b)), np.array([n, n]), 512)
    assert (s != np.uint64(2**64 - 1)).all()
    true = (n - n // 10) / (n + n // 10)
    assert abs((s[0] == s[1]).mean() - true) < 0.08


def test_blocks_of_large_components(spark, monkeypatch):
    """Two large families, some near enough to link through few members, with blocks of 20."""
    from pagewright.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", 20)
    monkeypatch.setattr(minhash, "LARGE", 4)
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(100)]
    other = base[:84] + [f"o{i}" for i in range(16)]
    rows = []
    for i in range(240):
        w = list(base if i % 2 else other)
        for j in rng.integers(0, 100, rng.integers(0, 14)):
            w[j] = f"new{rng.integers(0, 99999)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 1)
    assert 2 < len({x[1] for x in want.values()}) < 200
    assert result(near_duplicates(docs, k=1)) == want


def test_overlaps():
    from pagewright.llm.minhash import _overlaps

    rng = np.random.default_rng(0)
    x, y = ([np.unique(rng.integers(0, 300, 80)) for _ in range(n)] for n in (90, 70))
    assert (_overlaps(x, y) == [[len(np.intersect1d(a, b)) for b in y] for a in x]).all()


def test_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text)] * 3 + [(2, text)] * 2 + [(3, "other words here")] * 4 + [(4, "")] * 2 + [(5, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs, k=2).collect())
    assert got == [(1, 1, True)] * 3 + [(2, 1, False)] * 2 + [(3, 3, True)] * 4 + [(4, 4, True)] * 2 + [(5, 5, True)]


def by_rows(rows, k):
    """What near_duplicates gives, worked out with a key for each row."""
    own = brute(list(enumerate(t for _, t in rows)), k)
    least = {}
    for key, (d, _) in enumerate(rows):
        c = own[key][1]
        least[c] = min((x for x in (least.get(c), d) if x is not None), default=None)
    return sorted(((d, own[key][0], least[own[key][1]], d == least[own[key][1]]) for key, (d, _) in enumerate(rows)), key=repr)


def test_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, a), (1, b), (2, b), (2, c), (3, c + " more"), (None, a), (None, c), (None, "alone"), (None, "alone"), (None, None), (4, None), (4, ""), (5, "x"), (5, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in near_duplicates(docs, k=2).collect()), key=repr)
    assert got == by_rows(rows, 2)


def test_crowded_buckets_without_links(spark, monkeypatch):
    """Pages of one template that are almost near enough: blocks, whose rows grow with the pages, and no pairs."""
    from pagewright.llm import minhash

    monkeypatch.setattr(minhash, "CROWD", 8)
    monkeypatch.setattr(minhash, "PART", 16)
    rng = np.random.default_rng(2)
    base = [f"t{i}" for i in range(170)]
    rows = [(i, " ".join(base + [f"own{i}_{j}" for j in range(30 if i % 10 else 8)])) for i in range(300)]
    rows += [(1000 + i, " ".join(rows[int(rng.integers(0, 300))][1].split()[:-2])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # with few bands of one row, all pages meet
    got = result(near_duplicates(docs, k=1, bands=16, rows=2))
    assert got == brute(rows, 1)


def test_crowds_make_no_pairs(spark, monkeypatch):
    """Rows of blocks grow with a bucket's rows, by the number of its chunks; every two rows meet in just one block."""
    from pagewright.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", 100)
    for m, chunks in ((100, 1), (800, 8)):
        small = spark.range(m).selectExpr("7L as bucket", "1 as n", "id as rep", "id as c")
        rows = minhash._crowd_blocks(small, spark.createDataFrame([(7, m)], "bucket long, k long")).collect()
        assert len(rows) == m * chunks
    met = defaultdict(int)
    cells = defaultdict(list)
    for r in rows:
        cells[r.i, r.j].append(r)
    assert len(cells) == chunks * (chunks + 1) // 2
    for own in cells.values():
        for a in own:
            for b in own:
                if a.rep < b.rep and {a.side, b.side} != {0} and {a.side, b.side} != {1}:
                    met[a.rep, b.rep] += 1
    assert len(met) == m * (m - 1) // 2 and set(met.values()) == {1}
    assert minhash._crowd_blocks(small, spark.createDataFrame([(7, minhash.CROWD)], "bucket long, k long")).count() == 0


def test_blocks_are_bounded_by_shingles(spark, monkeypatch):
    """Long texts make more chunks than their number asks for; the links are the same."""
    from pagewright.llm import minhash

    few = spark.createDataFrame([(1, 100, 200), (2, 100, 5_000_000), (3, 3000, 3000)], "b long, k long, s long")
    assert {r.b: r.n for r in few.select("b", minhash._chunks(F.col("k"), F.col("s")).alias("n")).collect()} == {1: 1, 2: 3, 3: 2}
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 900)
    monkeypatch.setattr(minhash, "LARGE", 4)
    rng, base = np.random.default_rng(3), [f"b{i}" for i in range(100)]
    rows = []
    for i in range(120):
        w = list(base)
        for j in rng.integers(0, 100, rng.integers(0, 16)):
            w[j] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(w)))
    assert result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=1)) == brute(rows, 1)
