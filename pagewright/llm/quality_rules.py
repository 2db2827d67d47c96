"""Quality rules whose verdicts lean on the host.

Each document is held against a few rules. A host's rate of failing documents is shrunk with a
beta prior, fitted to all hosts' rates by moments. A document that fails a rule stays only on a
host whose shrunk rate shows that its failures are exceptions; one that passes goes only with a
host that is bad beyond doubt. DataFrame functions alone; a document's repeats are found within
its own row, so the only shuffles are of counts by host and of slim rows to join verdicts back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stash, table

SPACE = "[\\x20\\x09-\\x0D]+"
WINDOW = 5


def _repeat_words(words: Column) -> Column:
    """Words in windows that are found twice or more; exact, in n log n."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("w"), i.alias("at")))
    sorted_ = F.array_sort(windows)

    def starts(s: Column) -> Column:
        pairs = F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["w"] == x["w"]) | (F.get(s, i + 1)["w"] == x["w"]), x["at"]))
        return F.sort_array(F.array_compact(pairs))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    # a one-element transform binds a value once, for all its uses
    bound = F.transform(F.array(sorted_), starts)
    return F.element_at(F.transform(bound, covered), 1)


def features(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of docs and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_upper, n_repeat_words (long).

    Words are runs of all but blanks, tabs, line feeds, vertical tabs, form feeds and carriage returns.
    n_lines: lines (split at \\n) with a word; n_dup_lines: those equal to an earlier one. Null and empty texts have zeros.
    """
    d = docs.select(*columns, F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    hashes = F.when(F.size("words") > WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW))))
    d = d.select(
        *columns,
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("text", F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
        hashes.alias("hashes"),
    )
    # equal windows have equal hashes: a text without equal hashes repeats nothing
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    d = d.withColumn("n_repeat_words", F.when(F.coalesce(repeats, F.lit(False)), _repeat_words(F.col("words"))).otherwise(F.lit(0)).cast("long"))
    return d.drop("words", "hashes")


def failures() -> dict[str, Column]:
    """The rules that a document fails, by name."""
    c = F.col
    return {
        "short": c("n_words") < 10,
        "repeats": 100 * c("n_repeat_words") > 20 * c("n_words"),
        "symbols": 10 * c("n_symbols") > c("n_words"),
        "lines": 10 * c("n_dup_lines") > 3 * c("n_lines"),
        "capitals": 2 * c("n_upper") > c("word_chars"),
        "long_words": c("word_chars") > 20 * c("n_words"),
    }


BASE = ("short", "repeats")


def host_verdicts(hosts: DataFrame, trusted: float = 0.02, bad: float = 0.9) -> DataFrame:
    """hosts (host, n, failed) with rate, the posterior mean, and trusted and bad, its verdicts.

    The prior beta(a, b) has the mean and variance of the hosts' rates (a + b: 1 to 1000; 2 where there is no more than one host).
    bad: the mean less two posterior deviations is above `bad`. trusted: the mean is below `trusted`.
    """
    r = hosts.agg(F.avg(F.col("failed") / F.col("n")).alias("m"), F.var_pop(F.col("failed") / F.col("n")).alias("v")).first()
    m, v = (0.5, 0.0) if r.m is None else (min(max(r.m, 1e-6), 1 - 1e-6), r.v or 0.0)
    strength = 2.0 if hosts.limit(2).count() < 2 else min(1000.0, max(1.0, m * (1 - m) / v - 1 if v > 0 else 1000.0))
    total = F.col("n") + F.lit(strength)
    rate = (F.col("failed") + F.lit(m * strength)) / total
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (total + 1))
    return hosts.withColumn("rate", rate).withColumn("bad", F.col("rate") - 2 * spread > bad).withColumn("trusted", F.col("rate") < trusted)


def apply_rules(docs: DataFrame, host: str = "source", trusted: float = 0.02, bad: float = 0.9) -> DataFrame:
    """(doc_id, host, the features, failed_rules, base_failed, host_rate, kept) of all docs (doc_id, text and the column `host`).

    base_failed: fewer than 10 words, or more than a fifth of the words in repeated windows; never kept. A document that fails another rule is
    kept if its host is trusted; one that fails none, unless its host is bad. A null host is a host of its own, apart from the empty one. Rows that
    repeat are judged each; other columns are ignored; an empty table gives an empty result.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), "text")
    rules = failures()
    d = features(d, ["doc_id", "host"])
    d = d.withColumn("failed_rules", F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()])))
    d = stash(d.withColumn("base_failed", F.arrays_overlap("failed_rules", F.array(*map(F.lit, BASE)))))
    hosts = stash(d.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum((F.size("failed_rules") > 0).cast("long")).alias("failed")))
    verdicts = host_verdicts(hosts, trusted, bad).select(F.col("host").alias("_host"), F.col("rate").alias("host_rate"), "bad", "trusted")
    judged = d.join(verdicts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    kept = ~F.col("base_failed") & F.when(F.size("failed_rules") > 0, F.col("trusted")).otherwise(~F.col("bad"))
    return judged.withColumn("kept", kept).drop("bad", "trusted")


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH t AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
f AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
  length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS n_upper, w FROM f),
p AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM g WHERE len(w) > 5)),
q AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM p) WHERE c > 1),
r AS (SELECT doc_id, sum(least(5, coalesce(j - i, 5))) AS n FROM q GROUP BY doc_id),
s AS (SELECT g.*, coalesce(r.n, 0) AS n_repeat_words FROM g LEFT JOIN r USING (doc_id)),
u AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR 2 * n_upper > word_chars OR word_chars > 20 * n_words AS other FROM s),
h AS (SELECT host, count(*) AS n, sum((base_failed OR other)::INT) AS failed FROM u GROUP BY host),
m AS (SELECT least(greatest(avg(failed / n), 1e-6), 1 - 1e-6) AS m, var_pop(failed / n) AS v, count(*) AS c FROM h),
b AS (SELECT m, CASE WHEN c < 2 THEN 2.0 WHEN v > 0 THEN least(1000.0, greatest(1.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS k FROM m),
z AS (SELECT host, (failed + m * k) / (n + k) AS rate, n + k AS total FROM h, b)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND CASE WHEN other THEN rate < 0.02 ELSE NOT (rate - 2 * sqrt(rate * (1 - rate) / (total + 1)) > 0.9) END AS kept
FROM u JOIN z ON u.host IS NOT DISTINCT FROM z.host
"""

QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLES = {"op3_quality_rules": ORACLE}
