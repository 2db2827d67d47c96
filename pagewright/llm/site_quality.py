"""Quality classifier by hierarchical empirical Bayes.

Two logistic models (good quality; toxic), fitted on a bounded, hashed sample of labelled rows,
read a document's distinct words and heads of words (hashed) and bands of its shape. Their evidence p = P(good) *
(1 - P(toxic)) is summed by host and by path of a host. Rates shrink from path to host to the whole
corpus, each with a strength fitted by moments, so a sparse site has its parent's rate. A site's
excess log-odds over the corpus is added to those of each of its documents. Toxicity is judged by
document alone: a site's good name doesn't excuse it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stash, table
from ._words import ALNUM, LOWER, NOT_SPACE, U, buffers, word_bounds, word_hashes

#: Words and heads of words hash to the first DIM features; bands of shape follow.
DIM = 1 << 20
BANDS = 16
#: What is learned; features in so many rows or more whose rates differ by so many deviations between the classes are learned from.
HEADS_OF = ("quality", "toxic")
LEAST, DEVIATIONS = 4, 4.0
COUNTS = ("feature", *[f"{p}_{h}" for h in HEADS_OF for p in ("n", "y")])
#: Besides words, their first so many bytes are features.
HEADS = (4, 6)
SHAPES = 7


def _band(x: np.ndarray) -> np.ndarray:
    """A share of 0 to 1 in bands that double from 1/512."""
    return np.clip(np.floor(np.log2(np.maximum(x, 1e-9) * 512)) + 2, 0, BANDS - 1).astype(np.int64)


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """The features present in each text; a few MB are in work at a time."""
    raw_all, offs_all = buffers(column)
    at = 0
    while at < len(column):
        to = min(len(column), max(at + 1, int(np.searchsorted(offs_all, offs_all[at] + 2_000_000, "right")) - 1))
        raw, offs = raw_all[offs_all[at] : offs_all[to]], offs_all[at : to + 1] - offs_all[at]
        starts, ends, counts = word_bounds(raw, offs, ALNUM)
        tokens = word_hashes(raw, starts, ends)
        heads = [word_hashes(raw, starts, np.minimum(ends, starts + n)) ^ U(n) for n in HEADS]
        _, _, chunks = word_bounds(raw, offs, NOT_SPACE)
        upto = np.concatenate(([0], np.cumsum(counts)))
        size = np.maximum(1, np.diff(offs))

        def share(flags: np.ndarray, per: np.ndarray = size) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
            return (total[offs[1:]] - total[offs[:-1]]) / np.maximum(1, per)

        marks = np.zeros(256, bool)
        marks[[ord(c) for c in "#*$%&|<>"]] = True
        same = np.concatenate(([False], tokens[1:] == tokens[:-1])) if len(tokens) else np.zeros(0, bool)
        run = np.concatenate(([0], np.cumsum(same)))
        shapes = [share(marks[raw], chunks), share(raw == 33, chunks), share(raw != LOWER[raw]), share((raw >= 48) & (raw < 58)), (run[upto[1:]] - run[upto[:-1]]) / np.maximum(1, counts), 1 / np.maximum(1, chunks)]
        ids = (np.stack([tokens, *heads]) & U(DIM - 1)).astype(np.int64)
        for d in range(to - at):
            own = np.unique(ids[:, upto[d] : upto[d + 1]])
            varied = len(own) / max(1, (1 + len(HEADS)) * int(counts[d]))
            bands = [DIM + j * BANDS + int(_band(np.array([s[d]]))[0]) for j, s in enumerate(shapes)] + [DIM + 6 * BANDS + min(BANDS - 1, int(varied * BANDS))]
            yield np.concatenate((own, bands))
        at = to


@dataclass
class Model:
    """Weights of the features and a bias, for log-odds."""

    weights: np.ndarray
    bias: float

    @classmethod
    def fit(cls, names: np.ndarray, rows: list[np.ndarray], y: np.ndarray, steps: int = 200, decay: float = 1e-3) -> Model:
        """Logistic regression (Adam on all rows). rows: for each the places in names of the features it has."""
        ones = float(np.clip((y.sum() + 1) / (len(y) + 2), 1e-6, 1 - 1e-6))
        w, b = np.zeros(len(names)), float(np.log(ones / (1 - ones)))
        if len(names) and len(rows):
            col, doc = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
            for t in range(1, steps + 1):
                z = np.bincount(doc, weights=w[col], minlength=len(rows)) + b
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
                gw, gb = np.bincount(col, weights=g[doc], minlength=len(w)) + decay * w, g.sum()
                m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
                mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
                c, d = 1 - 0.9**t, 1 - 0.99**t
                w -= 0.05 * (m / c) / (np.sqrt(v / d) + 1e-8)
                b -= 0.05 * (mb / c) / (np.sqrt(vb / d) + 1e-8)
        out = np.zeros(DIM + SHAPES * BANDS, np.float32)
        out[names] = w
        return cls(out, b)


def held_out() -> Column:
    """Labelled rows no model is fitted on: crc32 of the doc_id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = 10_000) -> tuple[Model, Model]:
    """(quality, toxicity) models from docs (doc_id, text) and labels (doc_id, quality, toxic), about `rows` labelled rows, chosen by a hash of doc_id.

    Of several labels of one doc_id, nulls aside, each kind counts if they agree, and is as null if they clash.
    """
    agreed = [F.when(F.min(h) == F.max(h), F.min(h)).alias(h) for h in HEADS_OF]
    labelled = labels.select("doc_id", *[F.col(h).cast("int").alias(h) for h in HEADS_OF]).where("doc_id is not null").groupBy("doc_id").agg(*agreed)
    total = labelled.count()
    part = min(1.0, rows / max(1, total))
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000)) < int(part * 1_000_000))
    sample = stash(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", *HEADS_OF))  # `rows` rows of three numbers are broadcast

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = list(features(batch.column("text")))
            flat, size = np.concatenate(own), [len(x) for x in own]
            names, place = np.unique(flat, return_inverse=True)
            columns = [pa.array(names)]
            for head in HEADS_OF:
                y = np.array([np.nan if v is None else min(1, max(0, v)) for v in batch.column(head).to_pylist()], float)
                each = np.repeat(y, size)
                for weights in (~np.isnan(each), np.nan_to_num(each)):
                    columns.append(pa.array(np.bincount(place, weights=weights, minlength=len(names)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, COUNTS)

    sums = sample.mapInArrow(count, ", ".join(f"{c} long" for c in COUNTS)).groupBy("feature").agg(*[F.sum(c).alias(c) for c in COUNTS[1:]])
    whole = sample.agg(*[f(F.when(F.col(h).isNotNull(), F.least(F.lit(1), F.greatest(F.lit(0), F.col(h))))).alias(f"{p}_{h}") for h in HEADS_OF for p, f in (("n", F.count), ("y", F.sum))]).first()
    telling = []
    for h in HEADS_OF:
        n, ones = whole[f"n_{h}"], whole[f"y_{h}"] or 0
        rate = F.col(f"n_{h}") / max(1, n)
        gap = F.abs(F.col(f"y_{h}") / max(1, ones) - (F.col(f"n_{h}") - F.col(f"y_{h}")) / max(1, n - ones))
        telling.append((F.lit(bool(0 < ones < n)) & (F.col(f"n_{h}") >= LEAST) & (gap > DEVIATIONS * F.sqrt(rate * (1 - rate) * (1 / max(1, ones) + 1 / max(1, n - ones))))).alias(h))
    chosen = sums.select("feature", *telling).where(" or ".join(HEADS_OF)).toPandas()  # DIM rows at most
    names = {h: np.sort(chosen.loc[chosen[h], "feature"].to_numpy(np.int64)) for h in HEADS_OF}
    every = np.unique(np.concatenate([*names.values(), np.zeros(0, np.int64)]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [x[np.isin(x, every)].astype(np.int32) for x in features(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), *[batch.column(h) for h in HEADS_OF]], ["x", *HEADS_OF])

    got = sample.mapInArrow(read, "x array<int>, " + ", ".join(f"{h} int" for h in HEADS_OF)).toPandas()  # `rows` rows
    models = []
    for h in HEADS_OF:
        known = got[got[h].notna()]
        held = [np.searchsorted(names[h], x[np.isin(x, names[h])]) for x in (np.asarray(x, np.int64) for x in known["x"])]
        models.append(Model.fit(names[h], held, known[h].to_numpy(float).clip(0, 1)))
    return models[0], models[1]


def evidence(docs: DataFrame, quality: Model, toxic: Model, columns: list[str]) -> DataFrame:
    """`columns` of docs, p_good and p_toxic: the classifiers' probabilities; both 0 for texts without a word."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*[docs.schema[c] for c in columns], T.StructField("p_good", T.DoubleType()), T.StructField("p_toxic", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast((quality, toxic))  # two arrays of DIM floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            p = np.zeros((2, len(batch)))
            for d, x in enumerate(features(batch.column("text"))):
                if len(x) > SHAPES:
                    p[:, d] = [1 / (1 + np.exp(-np.clip(float(m.weights[x].sum()) + m.bias, -30, 30))) for m in models]
            out = [batch.column(c) for c in columns] + [pa.array(p[0]), pa.array(p[1])]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(run, schema)


def _strength(groups: DataFrame, least: float = 1.0, most: float = 1000.0) -> float:
    """How many documents a parent's rate counts as, for groups (n, good, prior), by moments: the variance among groups beyond what their sizes explain."""
    rate = F.col("good") / F.col("n")
    noise = F.col("prior") * (1 - F.col("prior"))
    r = groups.agg(F.sum(F.col("n") * F.pow(rate - F.col("prior"), 2)).alias("s"), F.sum(noise).alias("e"), F.sum("n").alias("n"), F.sum(F.col("n") * noise).alias("w"), F.count(F.lit(1)).alias("g")).first()
    if not r.g or not r.n or r.n <= r.g:
        return most
    between = max(0.0, (r.s - r.e) / (r.n - r.g))
    mean = r.w / r.n
    return most if between <= mean / most else max(least, mean / between - 1)


def classify(scored: DataFrame, threshold: float = 0.6) -> DataFrame:
    """scored (doc_id, host, path, p_good, p_toxic) with host_rate, path_rate, score and kept.

    score: P(good) by the document's evidence and its site's excess log-odds, times 1 - p_toxic. kept: score is at least `threshold`.
    A null host or path is a site of its own, apart from the empty one. Sums by group come first, so a host of any size costs each task one row.
    """
    paths = stash(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p_good").alias("good")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    mean = min(max((whole.good or 0) / (whole.n or 1), 1e-4), 1 - 1e-4)
    hosts = hosts.withColumn("prior", F.lit(mean))
    a = _strength(hosts)
    hosts = hosts.select("host", ((F.col("good") + a * F.col("prior")) / (F.col("n") + a)).alias("host_rate"))
    paths = paths.join(hosts.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host"))).withColumn("prior", F.col("host_rate"))
    b = _strength(paths)
    paths = paths.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "host_rate", ((F.col("good") + b * F.col("prior")) / (F.col("n") + b)).alias("path_rate"))

    def odds(x: Column) -> Column:
        x = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), x))
        return F.log(x / (1 - x))

    site = odds(F.col("path_rate")) - float(np.log(mean / (1 - mean)))
    joined = scored.join(paths, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path"))).drop("_host", "_path")
    good = 1 / (1 + F.exp(-(odds(F.col("p_good")) + site)))
    return joined.withColumn("score", good * (1 - F.col("p_toxic"))).withColumn("kept", F.col("score") >= threshold)


def site_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, rows: int = 10_000, threshold: float = 0.6) -> DataFrame:
    """(doc_id, held_out, host, path, p_good, p_toxic, host_rate, path_rate, score, kept) of all docs (doc_id, text and what host and path are made of).

    Rows of labels that held_out() marks are not learned from. Null and empty texts and texts without a word have score near 0 and aren't kept. Repeated
    rows are judged each; other columns are ignored; an empty table gives an empty result; without labels, p_good and p_toxic are 1/2.
    """
    quality, toxic = fit(docs, labels.where(~held_out()), rows)
    d = docs.select("doc_id", held_out().alias("held_out"), host.cast("string").alias("host"), path.cast("string").alias("path"), "text")
    scored = stash(evidence(d, quality, toxic, ["doc_id", "held_out", "host", "path"]))
    return classify(scored, threshold)


def op9_site_quality_bayes(spark, sf_dir: str) -> DataFrame:
    """Hosts are sources; a source's documents of one language are a path, as the table has neither addresses nor paths."""
    out = site_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
    return out.select("doc_id", "held_out", "p_good", "p_toxic", "host_rate", "path_rate", "score", "kept")


QUERIES = {"op9_site_quality_bayes": op9_site_quality_bayes}
ORACLES: dict[str, str] = {}
