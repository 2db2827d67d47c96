import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagewright.llm._bpe import Encoder
from pagewright.llm.packing import _packed, byte_bpe_path, cuts, op5_harmonic_packing, pack
from tests.conftest import DATA

TOKENIZER, ENCODER = Tokenizer.from_file(byte_bpe_path()), Encoder(byte_bpe_path())
BITS = st.sampled_from(["it's", "'s", "'re", "'ll", "'", "''", " ", "  ", "\n", "\t", "a", "B", "é", "12", "½", "!", "?!", " ", "　", "日本", "<|endoftext|>", "x" * 70, "=" * 40, "m", "ve", "\x1c", "\x85"])


@settings(max_examples=600, deadline=None)
@given(st.lists(st.lists(BITS, max_size=12).map("".join), max_size=4))
def test_ids_equal_the_library(texts):
    ids, counts = ENCODER.encode(texts)
    want = [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_cuts():
    for capacity in (64, 2048):
        plan = cuts(capacity)
        assert all(sum(p) == n for n, p in enumerate(plan)) and max(map(len, plan)) <= 6
        assert sum(sum(capacity / (capacity // x) for x in p) for p in plan) < (1.01 if capacity > 999 else 1.05) * sum(range(capacity))


def check(rows, docs, capacity=2048):
    tokens = {}
    for d, t in docs:
        ids = TOKENIZER.encode(t or "", add_special_tokens=False).ids + [1]
        tokens[d] = np.array(ids, "<u4")
    seqs, pieces = {}, {}
    for r in rows:
        assert r.doc_tokens == len(tokens[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(tokens[r.doc_id][r.start : r.start + r.length].tobytes())
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for own, total in [(p, len(tokens[d])) for d, p in pieces.items()]:
        at = 0
        for s, n in sorted(own):
            assert s == at and n > 0
            at += n
        assert at == total
    assert set(pieces) == set(tokens) and sorted(seqs) == list(range(len(seqs)))
    for own in seqs.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    used = sum(map(len, tokens.values()))
    return 1 - used / (len(seqs) * capacity) if seqs else 0


def test_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert check(op5_harmonic_packing(spark, DATA).collect(), docs) < 0.02


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "a"), (4, " word" * 2047), (5, " word" * 2048), (6, "b " * 40_000), (7, "a<|endoftext|>b")]
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, k int, offset int")
    rows = pack(d, byte_bpe_path(), with_ids=True).collect()
    check(rows, docs)
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    twice = pack(d.union(d), byte_bpe_path(), with_ids=True).collect()
    assert sorted((r.doc_id, r.start, r.ids) for r in twice) == sorted((r.doc_id, r.start, r.ids) for r in rows * 2)
    assert pack(d.where("false"), byte_bpe_path(), with_ids=True).collect() == []
    check(pack(d, byte_bpe_path(), capacity=64).collect(), docs, 64)
    assert pack(d.where("false"), byte_bpe_path()).collect() == []


def test_ids_in_bytes():
    for ids, width in (([1, 65_535], 2), ([1, 65_536], 4), ([0], 2)):
        assert np.frombuffer(_packed(np.array(ids, "<u4")), f"<u{width}").tolist() == ids
