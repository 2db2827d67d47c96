import re

import duckdb
import numpy as np

from pagewright.llm import licenses as S
from tests.conftest import DATA_01

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(i, label) for p, label in S.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    labels, score = {x for _, x in places}, 1.0 if places else 0.0
    for t in S.templates(S.TEMPLATES, S.PERCENT)[len(S.PHRASES) :]:
        for b in range(0, len(w), S.STRIDE):
            block = w[b : b + S.BLOCK]
            n = len(set(block) & set(t["words"]))
            if n >= t["need"] and all(any(block[i : i + len(m)] == m for i in range(len(block))) for m in t["must"]):
                labels.add(t["label"])
                score = max(score, n / len(t["words"]))
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), score


def result(df):
    return sorted(((r.doc_id, *(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"))) for r in df.collect()), key=str)


def test_documents_and_sql(spark):
    rows = spark.read.parquet(f"{DATA_01}/documents.parquet").collect()
    df = S.op1_license_set_similarity(spark, DATA_01)
    got = result(df)
    assert got == sorted(((r.doc_id, *brute(r.text)) for r in rows), key=str)
    assert {"apache", "gpl", "mit", "cc-by"} <= {x[5] for x in got}
    duckdb.sql(f"create or replace view documents as select * from '{DATA_01}/documents.parquet'")
    sql = duckdb.sql(S.ORACLES["op1_license_set_similarity"])
    assert sorted(sql.fetchall(), key=str) == got and sql.columns == df.columns


def test_edges(spark):
    rng = np.random.default_rng(2)
    bits = ["GNU", "general", "public", "license", "mit", "MIT License", "cc", "by", "cc-by", "apache\nlicense", "version", "the", "under", "filler", "é", "permission is hereby granted", *S.TEMPLATES["bsd"], *S.TEMPLATES["mit"]]
    rows = [(1, None), (2, ""), (3, "GNU General\nPublic. License"), (4, "mitlicense mit"), (4, "mitlicense mit"), (5, "pad " * 62 + "gnu general public license"), (6, "mit license " * 9000)]
    rows += [(10 + i, " ".join(rng.choice(bits, rng.integers(0, 150)))) for i in range(80)]
    rows += [(100 + i, "x " * i + "Licensed under the Apache License") for i in range(55, 70)]
    d = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, words int")
    assert result(S.scan(d.repartition(4))) == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert S.scan(d.where("false")).collect() == []


def test_a_notice_has_the_labels_of_its_license_alone(spark):
    """The base phrases' labels stand beside, as they are told apart by nothing."""
    own = {label: {label} for label in S.TEMPLATES}
    own["gpl-3.0"], own["apache-2.0"] = {"gpl", "gpl-3.0"}, {"apache", "apache-2.0"}
    rows, want = [], {}
    for label, texts in S.TEMPLATES.items():
        for t in texts:
            for before, after in (("", ""), ("This work is made with care by 3 people of the version control club. ", " It is free, in all its 4 parts, by any other terms.")):
                want[len(rows)] = own[label] | ({"cc-by"} if "cc by" in t.lower() else set())
                rows.append((len(rows), before + t + after))
    plain = {"Licensed under CC BY 4.0.": {"cc-by"}, "Licensed under the CC BY-NC 4.0": {"cc-by", "cc-by-nc"}, "This program is free software: " + S.TEMPLATES["gpl-3.0"][1].replace("GNU General", "GNU Affero General") + " licensed": {"agpl"}}
    both = f"{S.TEMPLATES['gpl-3.0'][0]} It is also {S.TEMPLATES['agpl'][0]}."
    for t, labels in [*plain.items(), (both, {"gpl", "gpl-3.0", "agpl"})]:
        want[len(rows)] = labels
        rows.append((len(rows), t))
    got = {r.doc_id: set(r.labels.split(",")) for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
