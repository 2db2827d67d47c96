import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pagewright.llm import site_quality as Q
from tests.conftest import DATA_01

SF_1 = "/root/testdata/sf0.1"


def test_held_out(spark):
    got = Q.op9_site_quality_bayes(spark, SF_1).join(spark.read.parquet(f"{SF_1}/labels.parquet"), "doc_id").where("held_out").collect()
    good = [r for r in got if r.quality == 1 and r.toxic == 0]
    toxic = [r for r in got if r.toxic == 1]
    junk = [r for r in got if r.quality == 0]
    rates = [np.mean([r.kept for r in x]) for x in (good, toxic, junk)]
    print(rates, len(got))
    assert rates[0] > 0.95 and rates[1] < 0.35 and rates[2] < 0.35


def strength(groups):
    """(n, good, prior) of each group: how many documents the prior counts as."""
    n, g = sum(x[0] for x in groups), len(groups)
    if not g or n <= g:
        return 1000.0
    s = sum(m * (good / m - p) ** 2 for m, good, p in groups)
    e = sum(p * (1 - p) for _, _, p in groups)
    between = max(0.0, (s - e) / (n - g))
    mean = sum(m * p * (1 - p) for m, _, p in groups) / n
    return 1000.0 if between <= mean / 1000 else max(1.0, mean / between - 1)


def twin(rows, threshold=0.6):
    """classify() by plain sums: {doc_id: (host_rate, path_rate, score, kept)}."""
    hosts, paths = {}, {}
    for _, h, p, good, _ in rows:
        for at, key in ((hosts, h), (paths, (h, p))):
            n, s = at.get(key, (0, 0.0))
            at[key] = n + 1, s + good
    mean = min(max(sum(r[3] for r in rows) / len(rows), 1e-4), 1 - 1e-4)
    a = strength([(n, s, mean) for n, s in hosts.values()])
    host_rate = {h: (s + a * mean) / (n + a) for h, (n, s) in hosts.items()}
    b = strength([(n, s, host_rate[h]) for (h, _), (n, s) in paths.items()])
    path_rate = {k: (s + b * host_rate[k[0]]) / (n + b) for k, (n, s) in paths.items()}

    def odds(x):
        x = min(max(x, 1e-9), 1 - 1e-9)
        return np.log(x / (1 - x))

    out = {}
    for d, h, p, good, toxic in rows:
        score = (1 - toxic) / (1 + np.exp(-(odds(good) + odds(path_rate[h, p]) - np.log(mean / (1 - mean)))))
        out[d] = host_rate[h], path_rate[h, p], score, score >= threshold
    return out, a, b


def test_classify_against_plain_sums(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f"h{i % 7}", f"p{i % 3}", float(rng.random()) ** (1 + i % 7), float(rng.random()) / 3) for i in range(3000)]
    rows += [(9000, None, None, 0.9, 0.0), (9001, "lone", "x", 0.01, 0.0), (9002, "", "", 0.2, 0.0), (9003, None, "", 0.7, 0.1), (9004, "", None, 0.3, 0.0), (9005, "h1", None, 0.99, 0.0)]
    rows += [(10_000 + i, f"site{i // 3}", f"p{i % 2}", float(rng.random()), 0.0) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, host string, path string, p_good double, p_toxic double")
    got = {r.doc_id: (r.host_rate, r.path_rate, r.score, r.kept) for r in Q.classify(d).collect()}
    want, a, b = twin(rows)
    assert 1 < a < 1000 and 1 <= b <= 1000 and len(got) == len(rows)
    for i, w in want.items():
        assert np.allclose(got[i][:3], w[:3], rtol=1e-9) and got[i][3] == w[3], i
    # a sparse site leans on its parent
    mean = np.mean([r[3] for r in rows])
    assert abs(got[9001][0] - mean) < abs(0.01 - mean)


def test_classify_of_one_site_and_of_equal_sites(spark):
    for rows in ([(1, "a", "b", 0.7, 0.0), (2, "a", "b", 0.2, 0.5)], [(i, f"h{i}", None, 0.5, 0.0) for i in range(20)]):
        d = spark.createDataFrame(rows, "doc_id long, host string, path string, p_good double, p_toxic double")
        got = {r.doc_id: (r.host_rate, r.path_rate, r.score) for r in Q.classify(d).collect()}
        want, _, _ = twin(rows)
        assert all(np.allclose(got[i], want[i][:3]) for i in got) and len(got) == len(rows)


def test_edges(spark):
    rows = [(1, None, "a", "b"), (2, "", "a", None), (3, "!!! ###", None, "b"), (4, "good text here", "a", "b"), (4, "good text here", "a", "b"), (5, "w " * 60_000, "a", "b")]
    d = spark.createDataFrame([(*r, 1.0, "k") for r in rows], "doc_id long, text string, source string, lang string, score double, kept string")
    labels = spark.createDataFrame([(4, 1, 0), (1, 0, 0), (1, 0, 0), (99, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = Q.site_quality(d, labels, F.col("source"), F.col("lang")).collect()
    assert len(got) == 6 and not any(r.kept for r in got if r.doc_id < 3)
    assert len(Q.site_quality(d, labels.where("false"), F.col("source"), F.col("lang")).collect()) == 6
    assert Q.site_quality(d.where("false"), labels, F.col("source"), F.col("lang")).collect() == []
    assert DATA_01
    x = list(Q.features(pa.array(["A b a", None])))
    assert len(x) == 2 and len(x[0]) == 6 + Q.SHAPES and len(x[1]) == Q.SHAPES


def test_labels_that_clash_count_as_none(spark):
    """In any order, the model is that of the labels without them; labels that repeat count once."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice([f"{'good' if i % 2 else 'junk'}{j}" for j in range(30)], 40))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    schema = "doc_id long, quality int, toxic int"
    plain = [(i, i % 2, int(i % 5 == 0)) for i in range(160)]
    clash = [(i, q, t) for i in range(160, 200) for q, t in ((1, 0), (0, None), (None, 0))]
    agreed = [(i, None, 0) for i in range(160, 200)]
    want = [m.weights.tolist() for m in Q.fit(docs, spark.createDataFrame(plain + agreed, schema))]
    for seed in (1, 2):
        both = plain * 2 + clash
        np.random.default_rng(seed).shuffle(both)
        got = Q.fit(docs, spark.createDataFrame([tuple(None if v is None else int(v) for v in r) for r in both], schema).repartition(5))
        assert [np.allclose(m.weights, w) for m, w in zip(got, want)] == [True, True]
