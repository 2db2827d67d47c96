import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagewright.llm import simhash as S
from tests.conftest import DATA_01

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_fingerprint(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, bits=4):
    """The least id of each id's component, by all pairs."""
    values = sorted(set(fps.values()))
    x = np.array(values, np.uint64)
    up = list(range(len(x)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[:i]) <= bits):
            up[root(i)] = root(int(j))
    at, least = {v: root(i) for i, v in enumerate(values)}, {}
    for i, v in fps.items():
        least[at[v]] = min(i, least.get(at[v], i))
    return {i: least[at[v]] for i, v in fps.items()}


def test_documents(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA_01}/documents.parquet").collect()}
    fps = {i: slow_fingerprint(t) for i, t in rows.items()}
    want = groups(fps)
    got = S.op13_simhash_near_dedup(spark, DATA_01)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.collect()} == {i: (f"{v:016x}", want[i]) for i, v in fps.items()}
    assert len(set(want.values())) < len(want)


def test_edges(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "One"), (9, "oNE"), (10, "É two\x0bthree"), (11, "é two three"), (12, "a b c d"), (12, "a b  c D"), (None, "a b c d"), (None, "w " * 30_000), (1, "x" * 100_000)]
    got = S.near_duplicates(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp int, component_id int"))
    assert got.columns == ["doc_id", "fp", "n_class", "component_id"]
    found = defaultdict(list)
    for r in got.collect():
        found[r.doc_id].append((r.fp & (1 << 64) - 1, r.component_id, r.n_class))
    assert found[5] == found[6] == found[7] == [(0, 5, 3)]
    assert found[8] == [(slow_fingerprint("one"), 8, 2)] and found[9][0][1] == 8
    assert found[10][0][0] != found[11][0][0]
    assert found[12] == [(slow_fingerprint("a b c d"), 12, 3)] * 2 and sorted(x[1] is None for x in found[None]) == [False, True]
    assert sum(map(len, found.values())) == len(rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).collect() == []


def test_repeated_shingles_count_and_blocks_of_shingles(monkeypatch):
    text = "a b c d a b c d a b c d e f g " * 40
    whole = S.fingerprint(text.encode(), 4, 42) & (1 << 64) - 1
    assert whole == slow_fingerprint(text)
    monkeypatch.setattr(S, "STEP", 7)
    assert S.fingerprint(text.encode(), 4, 42) & (1 << 64) - 1 == whole


def test_counts_bound_the_distance(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 500).astype(np.uint64)
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long").select("fp", S.counts_code(F.col("fp")).alias("code"))
    code = {r.fp: r.code & (1 << 64) - 1 for r in df.collect()}
    for a, b in zip(x[:-1], x[1:]):
        counts = [[bin(int(v) >> i & 3).count("1") for i in range(0, 64, 2)] for v in (a, b)]
        manhattan = sum(abs(p - q) for p, q in zip(*counts))
        assert bin(code[int(a.view(np.int64))] ^ code[int(b.view(np.int64))]).count("1") == manhattan <= bin(int(a ^ b)).count("1")


@pytest.mark.parametrize("bands", [5, 6, 8, None])
@pytest.mark.parametrize("block", [3, 2048])
def test_links_of_fingerprints(spark, monkeypatch, bands, block):
    """Chains, stars and a crowd of near copies, whatever the bands and the size of blocks."""
    monkeypatch.setattr(S, "BLOCK", block)
    rng = np.random.default_rng(4)
    flip = lambda v, n: v ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False))
    values = [int(v) for v in rng.integers(0, 1 << 62, 150)]
    chain = [values[0]]
    for _ in range(20):
        chain.append(flip(chain[-1], 4))
    crowd = [flip(values[1], int(rng.integers(0, 4))) for _ in range(120)]
    apart = [flip(v, 5) for v in values[:40]]
    fps = dict(enumerate([*values, *chain, *crowd, *apart, 0, 15, (1 << 64) - 1]))
    signed = [(i, v - (1 << 64) if v >> 63 else v) for i, v in fps.items()]
    rows = spark.createDataFrame(signed, "doc_id long, fp long")
    monkeypatch.setattr(S, "fingerprints", lambda docs, k, seed: docs.select("doc_id", "fp"))
    assert {r.doc_id: r.component_id for r in S.near_duplicates(rows, bands=bands).collect()} == groups(fps)


def test_every_pair_within_reach_shares_a_cell():
    for m in range(5, 13):
        masks = [x & (1 << 64) - 1 for x in S.grids(m, 4)]
        assert len(set(masks)) == len(masks)
        rng = np.random.default_rng(m)
        for _ in range(200):
            off = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(off & x == 0 for x in masks)
    assert S.bands_for(1000, 4) < S.bands_for(10**9, 4)


def test_a_crowd_gives_links_not_pairs():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    x = np.unique([3 ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (1500, 2))]).astype(np.uint64)
    n, zero = len(x), pa.array(np.zeros(len(x), np.int64))
    some = (x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)
    code = some | ((x & x >> np.uint64(1)) & np.uint64(0x5555555555555555)) << np.uint64(1)
    batch = pa.RecordBatch.from_arrays([zero, zero, zero, zero, pa.array(x.view(np.int64)), pa.array(code.view(np.int64))], [*S.CELL, "fp", "code"])
    cut = [batch.slice(i, 400) for i in range(0, n, 400)]
    assert sum(len(b) for b in S._links(4)(iter(cut))) == n - 1
