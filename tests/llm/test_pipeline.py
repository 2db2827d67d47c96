import re
import zlib

import numpy as np

import corpus_pipeline as P
from pagewright.llm import pii
from tests.conftest import DATA
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_minhash import brute as near
from tests.llm.test_packing import check
from tests.llm.test_pii import ANCHORS


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    before = rows(docs)
    for i, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i == 4:
            assert check(docs.collect(), before) < 0.05
            break
        after = rows(docs)
        assert docs.columns == columns and len(dict(after)) == len(after)
        assert all(r.n_chars == len(r.text) for r in docs.collect()) or i < 2
        text = dict(before)
        if i == 0:
            assert {d for d, t in before if t and re.search(r"[^\W\d_]{4}", t)} <= set(dict(after)) and all(t == text[d] for d, t in after)
        if i == 1:
            want = near(before, 5)
            assert {d for d, x in want.items() if x[2]} == set(dict(after)) and len(after) < len(before)
        if i == 2:
            hit = {d for d, x in leaks(before, bench).items() if x[4]}
            assert hit and all(t == text[d] for d, t in after if d not in hit) and {d for d, _ in before} - hit <= set(dict(after))
        if i == 3:
            assert set(dict(after)) == set(text)
            assert all(t == pii.redact(text[d], pii.find(text[d], ANCHORS)) for d, t in after)
        before = after


def test_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, DATA) if docs.columns[0] == "doc_id" else docs
        assert docs.count() == 0


def test_null_and_clashing_ids(spark):
    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcdef"]
    docs = [(None, texts[0]), (None, texts[1]), (7, texts[1]), (7, texts[2]), (7, texts[2]), (7, texts[3]), (3, texts[3]), (None, texts[4]), (None, texts[4]), (None, ""), (None, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = [(None, texts[0]), (7, texts[1]), (7, texts[2]), (3, texts[3]), (None, texts[4]), (None, ""), (None, "")]
    assert sorted(map(tuple, P.drop_near_duplicates(spark, df, DATA).collect()), key=repr) == sorted(want, key=repr)


def test_no_language_learned(spark):
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2][0]
    docs = spark.createDataFrame([(100, "clean text stays", None), (held, "held out", "en"), (102, "123 ...", None), (103, None, None)], "doc_id long, text string, lang string")
    assert sorted(map(tuple, P.identify_language(spark, docs, DATA).collect())) == [(held, "held out", "en"), (100, "clean text stays", None)]


def test_sequences_can_be_rebuilt(spark):
    docs = spark.createDataFrame([(1, "some words to pack " * 300), (2, None), (3, "é")], "doc_id long, text string")
    rows = P.pack(spark, docs, DATA).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert {r.doc_id for r in rows} == {1, 2, 3}
