import re

from pagewright.operators import phrases as P
from pagewright.operators.phrases import phrase_counts
from pagewright.plans.text_queries import q_phrases
from tests.conftest import DATA_01


def brute(docs, items):
    return sorted((d, i, s, t.count(p)) for d, t in docs if t for i, s, p in items if p and p in t)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def sentences(text):
    return [x.strip(" ") for x in re.findall(r"[^.!?]+[.!?]*", text.replace("\n", " ")) if x.strip(" ")]


def test_documents(spark):
    """All pairs, with any ids, and whole sentences."""
    docs = [(r.doc_id, (r.text or "").replace("\n", " ")) for r in spark.read.parquet(f"{DATA_01}/documents.parquet").collect()]
    bench = [(r.item_id, s, p) for r in spark.read.parquet(f"{DATA_01}/benchmark.parquet").collect() for s, p in enumerate(sentences(r.text or ""))]
    got = result(q_phrases(spark, DATA_01))
    assert got == brute(docs, bench)
    assert any(i % 5 != d % 5 for d, i, _, _ in got)


def test_lengths_places_and_blocks(spark, monkeypatch):
    items = [(0, 0, "é"), (1, 0, "a"), (1, 1, "ab"), (2, 0, "aba"), (3, 0, "one two three four five"), (3, 1, "one two three four six"), (4, 0, "aa"), (5, 0, ""), (6, 0, None), (7, 0, "aa"), (8, 0, "seven b")]
    docs = [(10, "one two three four five one two three four five"), (11, "aaaaa"), (12, None), (13, ""), (14, "ababa é"), (15, "x one two three four"), (16, " six"), (17, "one two three four six " * 9), (18, "seven bytes")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, sentence int, phrase string")
    want = brute(docs, items)
    for limit in (10**9, 20):
        monkeypatch.setattr(P, "BLOCK_CHARS", limit)
        assert result(P.phrase_counts(d.repartition(3), b)) == want
    monkeypatch.setattr(P, "STEP_BYTES", 8)
    assert result(P.phrase_counts(d.coalesce(1), b)) == want
    assert result(P.phrase_counts(d, b.where("false"))) == [] == result(P.phrase_counts(d.where("false"), b))


def slow_links(text, known):
    """The choice by plain scans: each phrase's occurrences from the left, then the leftmost and longest."""
    hits = []
    for phrase, href in known.items():
        at = text.find(phrase)
        while at >= 0:
            hits.append((at, -len(phrase), href))
            at = text.find(phrase, at + len(phrase))
    out, last = [], 0
    for at, shorter, href in sorted(hits):
        if at >= last:
            last = at - shorter
            out.append((at, -shorter, href))
    return out


def test_an_automaton_chooses_as_scans_do():
    import random

    from pagewright.operators.links import Dictionary

    for seed in range(200):
        rng = random.Random(seed)
        word = lambda most: "".join(rng.choice("abé") for _ in range(rng.randint(1, most)))
        known = {word(4): f"h{i}" for i in range(rng.randint(1, 12))}
        text = word(60)
        assert Dictionary(list(known.items())).chosen(text) == slow_links(text, known)


def test_links_of_many_phrases(spark):
    """Ten thousand phrases of a document, on runs with and without links, and documents without a dictionary."""
    import time

    from pagewright.operators import links
    from pagewright.schema import FRAGMENT

    p = lambda text, runs=None, kind="p": (kind, text, None, None, runs, *[None] * 6)
    blocks = [p("see phrase 77 and phrase 7777 here"), p("one phrase 9, two", [("one ", True, False, False, None), ("phrase 9", False, False, False, "http://own"), (", phrase 10.", False, False, False, None)]), p("phrase 1", None, "h"), p("none"), p(None)]
    f = spark.createDataFrame([(1, n, [], blocks, []) for n in range(1, 21)] + [(2, 1, [], blocks, [])], FRAGMENT)
    known = spark.range(10_000).selectExpr("1L as doc_id", "concat('phrase ', id) as phrase", "concat('#', id) as href").union(spark.createDataFrame([(1, "", "#e"), (1, "none", None)], "doc_id long, phrase string, href string"))
    began = time.time()
    rows = links.link_phrases(f, known).orderBy("doc_id", "page_number").collect()
    assert time.time() - began < 60 and len(rows) == 21
    own = [[(r.text, r.href) for r in b.runs] if b.runs else None for b in rows[0].blocks]
    assert own == [[("see ", None), ("phrase 77", "#77"), (" and ", None), ("phrase 7777", "#7777"), (" here", None)], [("one ", None), ("phrase 9", "http://own"), (", ", None), ("phrase 10", "#10"), (".", None)], None, None, None]
    assert rows[-1].blocks[0].runs is None


def test_phrases_of_one_frame(spark):
    """Phrases that begin alike are told apart by more of their bytes than sixteen."""
    frame = "A prompt that begins all of them"
    phrases = [(i, 0, f"{frame} {i} and goes on in its own way {i * i}") for i in range(300)]
    p = spark.createDataFrame(phrases, "item_id long, sentence int, phrase string")
    docs = spark.createDataFrame([(1, " | ".join(x[2] for x in phrases[::7])), (2, frame)], "doc_id long, text string")
    assert sorted((r.item_id, r.n) for r in phrase_counts(docs, p).collect()) == [(i, 1) for i in range(0, 300, 7)]
