"""Sharding by balanced label propagation.

Documents start in shards by a hash, which is their first label. Documents of equal text make a unit; links given besides
(near duplicates, say) tie units to one another. In each round a unit reads the labels of its neighbours, its own documents
among them, and asks for the shard where most of them are; shards seat units under quotas, those of more documents first, then in
the order of a hash. A unit that finds no room asks again among the shards that have some; one larger than any shard's room
fills a shard and the rest moves on. The next round votes by the new labels. Rounds end when no unit moves, or when fewer
cut links can't be had that way. Votes, units and moves are rows by (unit, shard), so a unit of any size costs at most as
many rows as there are shards. At last unlinked documents even out the shards to the row: sizes differ by one at most (the law `rows`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import join_hot, rank_buckets, ranked, stash, table


def _cases(values: list[int], by: Column) -> Column:
    """values[by], for a column `by` of small integers."""
    return F.element_at(F.array(*map(F.lit, values)), (by + 1).cast("int"))


def votes_of(labels: DataFrame, links: DataFrame | None) -> DataFrame:
    """(unit, shard, votes): how many neighbours a unit has in a shard.

    labels (unit, shard, m): m of a unit's documents are in the shard. links (a, b, w), each in both directions: w links between documents of two units.
    A neighbour that is spread over shards counts in each by its part. Votes are whole numbers, of a thousandth of a link.
    """
    own = labels.select("unit", "shard", (F.col("m") * 1000).alias("votes"))
    if links is None:
        return own
    sizes = labels.groupBy("unit").agg(F.sum("m").alias("n"))
    theirs = stash(labels.join(sizes, "unit").select(F.col("unit").alias("b"), "shard", "m", "n"))  # so that a unit of very many links can be split
    more = links.join(theirs, "b").select(F.col("a").alias("unit"), "shard", F.floor(F.col("w") * F.col("m") * 1000 / F.col("n")).alias("votes"))
    return own.union(more).groupBy("unit", "shard").agg(F.sum("votes").alias("votes"))


def cut_links(labels: DataFrame, links: DataFrame | None) -> int:
    """How many links lie between shards: pairs of documents of equal text, counted from sums, and of `links` the expected number."""
    each = F.col("m").cast("double")
    within = labels.groupBy("unit").agg(F.sum(each).alias("n"), F.sum(each * each).alias("s"))
    cut = within.agg(F.sum((F.col("n") * F.col("n") - F.col("s")) / 2)).first()[0] or 0
    if links is not None:
        sizes = labels.groupBy("unit").agg(F.sum("m").alias("n"))
        part = stash(labels.join(sizes, "unit").select("unit", "shard", (F.col("m") / F.col("n")).alias("p")))
        pairs = links.where("a < b")
        both = pairs.join(part.select(F.col("unit").alias("a"), "shard", F.col("p").alias("p")), "a").join(part.select(F.col("unit").alias("b"), "shard", F.col("p").alias("q")), ["b", "shard"])
        kept = both.agg(F.sum(F.col("w") * F.col("p") * F.col("q"))).first()[0] or 0
        cut += (pairs.agg(F.sum("w")).first()[0] or 0) - kept
    return round(cut)


def seat(units: DataFrame, votes: DataFrame, room: int, n_shards: int) -> DataFrame:
    """(unit, n, shard, upto): of a unit's documents, those ranked below `upto`, and not below a lesser one, go to the shard.

    units (unit, n): its documents. votes (unit, shard, votes). A shard takes up to `room` documents. Turns go on until no unit is left or no
    room is free; each fills a shard or seats a whole unit. Documents ranked past all of a unit's rows found no room.
    """
    groups = stash(units.select("unit", "n", F.lit(0).cast("long").alias("done")))
    free, placed = [room] * n_shards, []
    buckets = rank_buckets(groups.count())
    while (largest := max(free)) > 0 and not groups.isEmpty():
        left = F.col("n") - F.col("done")
        # of the shards with room for the whole unit, or, if there is none, of the roomiest, the one with most neighbours
        fits = _cases(free, F.col("shard")) >= F.least(left, F.lit(largest))
        shards = groups.select("unit", "n", "done", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard")).where(fits)
        known = shards.join(votes, ["unit", "shard"], "left")
        best = F.max(F.struct(F.coalesce("votes", F.lit(0)).alias("votes"), F.xxhash64("unit", "shard").alias("h"), "shard"))
        want = known.groupBy("unit", "n", "done").agg(best["shard"].alias("shard")).withColumn("w", F.col("n") - F.col("done"))
        size = F.lit(63) - F.floor(F.log2("w")).cast("int")
        want = stash(want.withColumn("bucket", (size * buckets + F.pmod(F.xxhash64("unit"), F.lit(buckets))).cast("int")))
        # how many go before a unit into its shard: all of the buckets before, and those before it in its own
        before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        shift = want.groupBy("shard", "bucket").agg(F.sum("w").alias("w"))
        shift = shift.select("shard", "bucket", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("shift"))
        inner = Window.partitionBy("shard", "bucket").orderBy("w", "unit").rowsBetween(Window.unboundedPreceding, -1)
        want = want.withColumn("ahead", F.coalesce(F.sum("w").over(inner), F.lit(0))).join(shift, ["shard", "bucket"])
        allowed = _cases(free, F.col("shard")) - F.col("shift") - F.col("ahead")
        part = F.when(allowed >= F.col("w"), F.col("w")).when(F.col("w") > largest, F.greatest(allowed, F.lit(0))).otherwise(0)
        want = stash(want.select("unit", "n", (F.col("done") + part).alias("done"), "shard", part.alias("part")))
        taken = {r.shard: r.n for r in want.groupBy("shard").agg(F.sum("part").alias("n")).collect()}  # a row for each shard
        free = [f - taken.get(i, 0) for i, f in enumerate(free)]
        placed.append(want.where("part > 0").select("unit", "n", "shard", F.col("done").alias("upto")))
        groups = want.where("done < n").select("unit", "n", "done")
    if not placed:
        return votes.select("unit", F.lit(0).cast("long").alias("n"), "shard", F.lit(0).cast("long").alias("upto")).where("false")
    out = placed[0]
    for more in placed[1:]:
        out = out.union(more)
    return out


def _labels_after(moves: DataFrame, start: DataFrame) -> DataFrame:
    """labels (unit, shard, m) after moves; of a unit's documents that found no room, one shard's worth counts where they started (their least shard)."""
    before = Window.partitionBy("unit").orderBy("upto")
    seated = moves.select("unit", "shard", (F.col("upto") - F.coalesce(F.lag("upto").over(before), F.lit(0))).alias("m"))
    held = moves.groupBy("unit").agg(F.max("upto").alias("done"))
    whole = start.groupBy("unit").agg(F.sum("m").alias("n"), F.min("shard").alias("shard"))
    left = whole.join(held, "unit", "left").select("unit", "shard", (F.col("n") - F.coalesce("done", F.lit(0))).alias("m")).where("m > 0")
    return seated.union(left).groupBy("unit", "shard").agg(F.sum("m").alias("m"))


def propagate(start: DataFrame, links: DataFrame | None, room: int, n_shards: int) -> tuple[DataFrame, list[int]]:
    """(moves, cut): moves as seat() gives them, and how many links are cut at the start and after each round that was kept.

    start (unit, shard, m): the m documents of a unit that start in a shard. links (a, b, w) between units, each in both directions, or none.
    A round is kept if it cuts fewer links than the one before; the first that doesn't, or one after which no link is cut, ends the rounds.
    """
    labels, cut = start, [cut_links(start, links)]
    units = stash(start.groupBy("unit").agg(F.sum("m").alias("n")))
    moves = None
    while moves is None or cut[-1] > 0:
        tried = stash(seat(units, votes_of(labels, links), room, n_shards))
        after = stash(_labels_after(tried, start))
        now = cut_links(after, links)
        if moves is not None and now >= cut[-1]:
            break
        moves, labels = tried, after
        cut.append(now)
    return moves, cut


@dataclass
class Sharded:
    """rows: (doc_id, size, text_crc32, shard, slot). cut: links between shards at the start, by hash, and after each round of propagation."""

    rows: DataFrame
    cut: list[int]


def balance(docs: DataFrame, n_shards: int = 8, edges: DataFrame | None = None) -> Sharded:
    """All docs (doc_id, text; other columns are ignored) in shards, as rows (doc_id, size, text_crc32, shard, slot).

    size: the text's UTF-8 bytes plus 1. Shards run from 0, slots in each from 0 without gaps; shards' rows differ by one
    at most. Documents of equal text are linked, and so are those of edges (a, b), pairs of doc_ids; null texts are linked by edges
    alone. Linked documents share a shard where room allows. doc_id tells rows apart; rows that repeat one wholly get a slot
    each, and an edge ties all rows of its ids. Null ids have no edge; edges of unknown ids, and of a text to itself, count for nothing. An
    empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(F.col("text").cast("binary"))).alias("unit"),
    )
    if edges is not None:  # a null text is a unit of its own
        rows = rows.withColumn("unit", F.coalesce("unit", F.unhex(F.md5(F.concat(F.lit("\0"), F.col("doc_id").cast("string")).cast("binary")))))
    rows = stash(rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(n_shards)).cast("int")))
    counts = stash(rows.where("unit is not null").groupBy("unit", "shard").agg(F.count(F.lit(1)).alias("m")))
    tied = counts.groupBy("unit").agg(F.sum("m").alias("n")).where("n > 1").select("unit")
    links = None
    if edges is not None:
        of = rows.where("unit is not null and doc_id is not null").select("doc_id", "unit").distinct()
        ends = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct()
        ends = ends.join(of.select(F.col("doc_id").alias("a"), F.col("unit").alias("ua")), "a").join(of.select(F.col("doc_id").alias("b"), F.col("unit").alias("ub")), "b").where("ua <> ub")
        both = ends.select(F.col("ua").alias("a"), F.col("ub").alias("b")).union(ends.select(F.col("ub").alias("a"), F.col("ua").alias("b")))
        links = stash(both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("w")))
        tied = tied.union(links.select("a")).distinct()
    total = rows.count()
    half = rank_buckets(total)
    quota = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    start = stash(counts.join(tied, "unit"))
    moves, cut = propagate(start, links, total // n_shards, n_shards)
    # a unit's moves: one for each turn at most
    moves = moves.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("upto", F.col("shard").alias("to")))).alias("moves"))
    moves = stash(start.groupBy("unit").agg(F.sum("m").alias("n")).join(moves, "unit", "left"))
    met = stash(join_hot(rows, moves, "unit", how="left"))  # null units have n null, as unlinked ones
    linked = ranked(met.where("n is not null"), ["unit"], ["doc_id"], F.xxhash64("doc_id"), "rank", half)
    to = F.get(F.filter("moves", lambda x: x["upto"] > F.col("rank")), F.lit(0))["to"]
    alone = met.where("n is null").select("doc_id", "size", "text_crc32", "shard", F.lit(False).alias("tied"))
    all_ = linked.select("doc_id", "size", "text_crc32", F.coalesce(to, F.col("shard")).alias("shard"), to.isNotNull().alias("tied")).union(alone)
    all_ = stash(all_)
    held = {r.shard: r.n for r in all_.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = [held.get(s, 0) for s in range(n_shards)]
    # the linked rank first, so that unlinked documents are what a full shard gives away
    spread = F.when(F.col("tied"), 0).otherwise(half) + F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(half))
    placed = stash(ranked(all_, ["shard"], ["doc_id", "text_crc32"], spread, "slot", 2 * half))
    over = F.col("slot") >= _cases(quota, F.col("shard"))
    stay = placed.where(~over).select("doc_id", "size", "text_crc32", "shard", "slot")
    given = ranked(placed.where(over).withColumn("all", F.lit(0)), ["all"], ["doc_id", "text_crc32", "slot", "shard"], F.xxhash64("doc_id"), "place", half)
    to, slot, at = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in range(n_shards):
        lack = max(0, quota[s] - held[s])
        here = (F.col("place") >= at) & (F.col("place") < at + lack)
        to, slot = F.when(here, F.lit(s)).otherwise(to), F.when(here, F.col("place") - at + held[s]).otherwise(slot)
        at += lack
    return Sharded(stay.union(given.select("doc_id", "size", "text_crc32", to.alias("shard"), slot.alias("slot"))), cut)


def shard_documents(docs: DataFrame, n_shards: int = 8, edges: DataFrame | None = None) -> DataFrame:
    """The rows of balance()."""
    return balance(docs, n_shards, edges).rows


def op10_balanced_label_propagation(spark, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op10_balanced_label_propagation": op10_balanced_label_propagation}
ORACLES: dict[str, str] = {}
