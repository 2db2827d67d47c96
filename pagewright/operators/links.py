"""Known phrases in text to links: a document's dictionary is one automaton, which finds all of its phrases in one pass; then a choice of matches that don't overlap."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.steps import once
from pagewright.schema import BLOCK, RUN

PHRASES = "array<struct<phrase:string,href:string>>"
HIT = "struct<start:int,n:int,href:string>"


def occurrences(text: Column, phrase: Column) -> Column:
    """Starts, from 0, of a phrase's occurrences in text that don't overlap, from the left."""
    gaps = F.split(text, F.concat(F.lit("\\Q"), F.replace(phrase, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), F.lit(-1))

    def start(k: Column) -> Column:
        before = F.aggregate(F.slice(gaps, F.lit(1), k), F.lit(0), lambda a, g: a + F.length(g))
        return before + (k - 1) * F.length(phrase)

    return F.when((F.length(phrase) > 0) & (F.size(gaps) > 1), F.transform(F.sequence(F.lit(1), F.size(gaps) - 1), start)).otherwise(F.array().cast("array<int>"))


def choose(hits: Column) -> Column:
    """Of hits (start, n, href), from the left and of equal starts the longest first, those that begin where none chosen before still runs."""
    order = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), (-h["n"]).alias("shorter"), h["href"].alias("href"))))

    def step(acc: Column, h: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        free = (F.size(acc) == 0) | (h["start"] >= last["start"] + last["n"])
        return F.when(free, F.concat(acc, F.array(F.struct(h["start"].alias("start"), (-h["shorter"]).alias("n"), h["href"].alias("href")).cast(HIT)))).otherwise(acc)

    return F.aggregate(order, F.array().cast(f"array<{HIT}>"), step)


def split_run(run: Column, phrases: Column) -> Column:
    """A run parted at the phrases chosen in it, of a short list; a run with a link, or without a phrase, stays as it is."""
    hits = F.flatten(F.transform(phrases, lambda p: F.transform(occurrences(run["text"], p["phrase"]), lambda s: F.struct(s.alias("start"), F.length(p["phrase"]).alias("n"), p["href"].alias("href")).cast(HIT))))
    free = ~F.coalesce(F.length(run["href"]) > 0, F.lit(False))
    return F.element_at(F.transform(F.array(F.when(free, choose(hits))), lambda chosen: part_run(run, chosen)), 1)


def part_run(run: Column, chosen: Column) -> Column:
    """A run parted at chosen hits, which carry their links; with none of them, or null, as it is."""

    def piece(a: Column, n: Column, href: Column) -> Column:
        return F.struct(F.substr(run["text"], a + 1, n).alias("text"), *[run[c].alias(c) for c in ("bold", "italic", "superscript")], href.cast("string").alias("href")).cast(RUN)

    def before(i: Column) -> Column:
        last = F.get(chosen, i - 1)
        return F.coalesce(last["start"] + last["n"], F.lit(0))

    inner = F.flatten(F.transform(chosen, lambda h, i: F.array(piece(before(i), h["start"] - before(i), F.lit(None)), piece(h["start"], h["n"], h["href"]))))
    end = before(F.size(chosen))
    parts = F.filter(F.concat(inner, F.array(piece(end, F.length(run["text"]) - end, F.lit(None)))), lambda r: F.length(r["text"]) > 0)
    return F.when(F.coalesce(F.size(chosen) > 0, F.lit(False)), parts).otherwise(F.array(run))


HITS = f"array<array<array<{HIT}>>>"


class Dictionary:
    """Phrases with their links, as one automaton."""

    def __init__(self, phrases: list[tuple[str, str]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for k, (phrase, href) in enumerate(phrases):
            self.automaton.add_word(phrase, (k, len(phrase), href))
        self.automaton.make_automaton()

    def chosen(self, text: str) -> list[tuple[int, int, str]]:
        """(start, n, href) of the phrases chosen in a text. A phrase's own occurrences don't overlap, from the left; of all, from the left and the longest first, those count that begin where none chosen before still runs."""
        runs_to: dict[int, int] = {}
        hits = []
        for end, (k, n, href) in self.automaton.iter(text):
            if end - n + 1 >= runs_to.get(k, 0):
                runs_to[k] = end + 1
                hits.append((end - n + 1, -n, href))
        out, last = [], 0
        for start, shorter, href in sorted(hits):
            if start >= last:
                last = start - shorter
                out.append((start, -shorter, href))
        return out


def _chosen(doc_ids: pa.Array, texts: pa.Array, phrases: pa.Array) -> pa.Array:
    """HITS of each page's texts (by block and run), by its document's phrases. Pages of one document that follow each other share an automaton."""
    out, own, known = [], object(), None
    for doc, page, them in zip(doc_ids, texts, phrases, strict=True):
        page = page.as_py() or []
        if len(them) == 0 or not any(t for b in page for t in b):
            out.append([[[] for _ in b] for b in page])
            continue
        if doc.as_py() != own or known is None:
            own, known = doc.as_py(), Dictionary([(p["phrase"], p["href"]) for p in them.as_py()])
        out.append([[[{"start": s, "n": n, "href": h} for s, n, h in known.chosen(t)] if t else [] for t in b] for b in page])
    hit = pa.struct([("start", pa.int32()), ("n", pa.int32()), ("href", pa.string())])
    return pa.array(out, pa.list_(pa.list_(pa.list_(hit))))


def link_phrases(fragments: DataFrame, phrases: DataFrame) -> DataFrame:
    """fragments with links on paragraphs and list items that hold a known phrase.

    phrases: (doc_id, phrase, href), a document's own dictionary, which has to fit a row; of equal phrases the greatest href counts.
    """
    known = phrases.where("phrase <> '' and href is not null").groupBy("doc_id", "phrase").agg(F.max("href").alias("href"))
    known = known.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("phrase", "href"))).alias("phrases"))
    plain = lambda b: F.array(F.struct(b["text"].alias("text"), *[F.lit(False).alias(c) for c in ("bold", "italic", "superscript")], F.lit(None).cast("string").alias("href")).cast(RUN))

    def runs_of(b: Column) -> Column:
        return F.when(F.coalesce(F.size(b["runs"]) > 0, F.lit(False)), b["runs"]).otherwise(plain(b))

    def texts(b: Column) -> Column:
        """Of each run its text, empty where no link may come."""
        open_ = b["type"].isin("p", "li") & (F.length(b["text"]) > 0)
        return F.transform(runs_of(b), lambda r: F.when(open_ & ~F.coalesce(F.length(r["href"]) > 0, F.lit(False)), r["text"]).otherwise(""))

    def own(b: Column, hits: Column) -> Column:
        names = [f.split(":")[0] for f in ("type", "text", "level", "ordered", "runs", "rows", "src", "alt", "caption", "column", "indent_em")]
        linked = F.struct(*[(F.flatten(F.transform(runs_of(b), lambda r, j: part_run(r, F.get(hits, j)))) if n == "runs" else b[n]).alias(n) for n in names]).cast(BLOCK)
        return F.when(F.exists(hits, lambda h: F.size(h) > 0), linked).otherwise(b)

    d = fragments.join(known, "doc_id", "left").withColumn("phrases", F.coalesce("phrases", F.array().cast(PHRASES)))
    # called non-deterministic, so that the optimiser doesn't move it into a lambda or a condition, where a Python function can't be
    search = F.arrow_udf(_chosen, HITS).asNondeterministic()
    d = once(d, "_texts", F.transform("blocks", texts))
    d = d.withColumn("_hits", search(F.col("doc_id").cast("long"), F.col("_texts"), F.col("phrases")))
    return d.withColumn("blocks", F.transform("blocks", lambda b, i: own(b, F.get(F.col("_hits"), i)))).select(*fragments.columns)
