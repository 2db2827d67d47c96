"""Importance resampling towards a target corpus, scored by hashed word runs.

A document's features are its runs of 1 to `longest` words; each falls into one of `n_buckets` buckets by its
CRC-32. A row's buckets are one array, made with higher-order functions and written once: a text is read
once, and no feature becomes a row to be scored. What is shuffled to learn the gains is counts alone, at most one row a bucket
from each task. A bucket's gain is the logarithm of its share in the target over its share in the documents; all gains are one literal
array, so a document's weight is a fold over its own buckets. To each weight comes noise drawn from a hash of the document's id, of
Gumbel's distribution: the highest sums are a sample without replacement whose chances follow the weights.

The drawn documents are found without sorting the corpus: the score of the last one is searched by counts of
`STEPS` ranges of scores at a time, and only rows from there on are dealt out by score and ranked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import lower_ascii, rank_buckets, ranked, release, stash, table

#: Words before lower-casing: the class of lower-cased words and A-Z.
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
LONGEST = 3
N_BUCKETS = 10_000
#: Ranges of scores that one pass of the search for the last drawn one tells apart.
STEPS = 1024


def words_of(text: Column) -> Column:
    """Lower-cased words (A-Z alone is lowered); null has none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    return F.transform(found, lambda w: F.when(w.rlike("[A-Z]"), lower_ascii(w)).otherwise(w))


def buckets_of(words: Column, longest: int = LONGEST, n_buckets: int = N_BUCKETS) -> Column:
    """array<short>, the bucket of each run of 1 to `longest` of the words, repeats included."""
    if n_buckets > 1 << 15:
        raise ValueError("a bucket's number has to fit a short")

    def bucket(run: Column) -> Column:
        return (F.crc32(run.cast("binary")) % n_buckets).cast("short")

    def runs(w: Column) -> Column:
        def of(k: int) -> Column:
            # the run's first k - 1 words are looked up from the place of its last
            last = F.slice(w, F.lit(k), F.greatest(F.size(w) - (k - 1), F.lit(0)))
            return F.transform(last, lambda x, i: bucket(F.concat_ws(" ", *[F.get(w, i + j) for j in range(k - 1)], x)))

        return F.concat(*[of(k) for k in range(1, longest + 1)])

    # a one-element transform binds the words once, for all their uses
    return F.element_at(F.transform(F.array(words), runs), 1)


def bucketed(docs: DataFrame, columns: list[str], longest: int = LONGEST, n_buckets: int = N_BUCKETS) -> DataFrame:
    """`columns` of docs, n_words (long) and buckets."""

    def both(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), buckets_of(w, longest, n_buckets).alias("buckets"))

    made = F.element_at(F.transform(F.array(words_of(F.col("text"))), both), 1)
    return docs.select(*columns, made.alias("_made")).select(*columns, "_made.n_words", "_made.buckets")


def totals(rows: DataFrame, n_buckets: int = N_BUCKETS) -> list[int]:
    """How many features of all rows fall into each bucket: one row a bucket comes back, whatever the rows."""
    counts = rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    out = [0] * n_buckets
    for r in counts.collect():
        out[r.bucket] = r.n
    return out


def gains(target: list[int], corpus: list[int]) -> list[int]:
    """floor(1000 ln(share in the target / share in the corpus)) of each bucket, one added to each count."""
    t_all, s_all, n = float(sum(target)), float(sum(corpus)), len(corpus)
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for t, s in zip(target, corpus, strict=True)]


def weight_of(buckets: Column, gain: list[int]) -> Column:
    """Sum of the gains of a row's buckets; 0 without any. The gains are text that the optimiser turns into one literal array."""
    known = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<long>")
    return F.aggregate(buckets, F.lit(0).cast("long"), lambda a, b: a + F.element_at(known, b.cast("int") + 1))


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) of an id; a null id counts as the empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def last_drawn(rows: DataFrame, value: str, k: int) -> int:
    """The k-th largest of a long column, k from 1 to its rows, by counts of ranges: each pass returns STEPS rows at most."""
    ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    lo, hi = ends.lo, ends.hi
    while lo < hi:
        width = -(-(hi - lo + 1) // STEPS)
        held = rows.where(F.col(value).between(lo, hi)).groupBy(F.floor((F.col(value) - lo) / width).alias("at")).agg(F.count(F.lit(1)).alias("n"))
        for r in sorted(held.collect(), key=lambda r: -r["at"]):
            if r.n >= k:
                lo, hi = lo + r["at"] * width, min(hi, lo + (r["at"] + 1) * width - 1)
                break
            k -= r.n
    return lo


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, longest: int = LONGEST, n_buckets: int = N_BUCKETS, seed: int = 42) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), all long, of each row of docs (doc_id, text; other columns are ignored).

    target (text): the corpus to come near to. Of the N rows with `least_words` words or more, floor(percent * N / 100) are drawn, those of the
    highest scores, ties to the smaller doc_id, a null one last; rank counts them from 1, and is null for all others.
    Null and empty texts, and those without words, have no feature and weight 0; they are scored and never drawn. An empty target counts
    nothing, as one without words. Repeated rows are drawn or not each by itself: of rows equal in all these columns any may be
    the one that comes first. An empty table gives an empty result.
    """
    rows = stash(bucketed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], longest, n_buckets))
    gain = gains(totals(bucketed(target, [], longest, n_buckets), n_buckets), totals(rows, n_buckets))
    slim = rows.select("doc_id", F.size("buckets").cast("long").alias("n_features"), weight_of(F.col("buckets"), gain).alias("weight"), (F.col("n_words") >= least_words).alias("able"))
    scored = stash(slim.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    release(rows)

    able = scored.where("able")
    n_drawn = percent * able.count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if n_drawn == 0:
        return scored.select(*columns, none)
    least = last_drawn(able, "score", n_drawn)
    high = F.col("able") & (F.col("score") >= least)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight"]
    parts = rank_buckets(n_drawn)
    # the part a row is dealt to is written with it, so that a lost task can't deal it out anew
    dealt = stash(scored.where(high).select(*columns).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    n_parts = (dealt.agg(F.max("part")).first()[0] or 0) + 1
    first = ranked(dealt, [], order, F.col("part"), "rank", n_parts)
    drawn = first.select(*columns, F.when(F.col("rank") < n_drawn, F.col("rank") + 1).alias("rank"))
    return drawn.union(scored.where(~high).select(*columns, none))


def op11_target_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 of a string, as DuckDB SQL: 256 table entries by the polynomial's rule, then a fold over the bytes.
CRC_TABLE = "(SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab)"


def crc_sql(x: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of string x; `tab` has to be a column of CRC_TABLE."""
    some_bytes = f"list_transform(range(octet_length(encode({x}))), lambda i: ('0x' || substr(hex(encode({x})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({some_bytes}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words_sql(of: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({of}, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _runs_sql(w: str) -> str:
    two, three = f"{w}[i] || ' ' || {w}[i + 1]", f"{w}[i] || ' ' || {w}[i + 1] || ' ' || {w}[i + 2]"
    return f"list_concat({w}, list_transform(range(1, len({w})), lambda i: {two}), list_transform(range(1, len({w}) - 1), lambda i: {three}))"


ORACLE = rf"""
WITH d AS (SELECT doc_id, {_words_sql('text')} AS w FROM documents),
b AS (SELECT {_words_sql('text')} AS w FROM benchmark),
df AS (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest({_runs_sql('w')}) AS f FROM d) GROUP BY doc_id, f),
bf AS (SELECT unnest({_runs_sql('w')}) AS f FROM b),
k AS (SELECT f, {crc_sql('f')} % {N_BUCKETS} AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf), {CRC_TABLE}),
s AS (SELECT bucket, sum(n) AS s FROM df JOIN k USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN k USING (f) GROUP BY bucket),
a AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS s_all, coalesce((SELECT sum(t) FROM t), 0) AS t_all),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + {N_BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + {N_BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket), a),
w AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM df JOIN k USING (f) JOIN g USING (bucket) GROUP BY doc_id),
r AS (SELECT doc_id, len(w) AS n_words, greatest(3 * len(w) - 3, len(w), 2 * len(w) - 1, 0)::BIGINT AS n_features,
  coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN w USING (doc_id)),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS o, count(*) OVER () AS n FROM r WHERE n_words >= 20)
SELECT doc_id, CASE WHEN n_words = 0 THEN 0 WHEN n_words = 1 THEN 1 ELSE n_features END::BIGINT AS n_features, weight, score,
  CASE WHEN o <= 5 * n // 100 THEN o END::BIGINT AS rank
FROM r LEFT JOIN o USING (doc_id)
"""

QUERIES = {"op11_target_resampling": op11_target_resampling}
ORACLES = {"op11_target_resampling": ORACLE}
