"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A text is its set of distinct k-word shingles (64-bit hashes). The sketch throws all elements
into t bins, round by round, a round's values above those of the round before; from round t on,
round t + j throws all into bin j, so that every bin is filled. It takes about t ln t + n
hashes instead of t n, and its coordinates are as concentrated as t independent ones.

Equal sets form one class. A class's representative goes to `bands` buckets. In each, it is
paired with the bucket's first and with its neighbour by size (linear in the rows); true links
among those make components. Only buckets that still hold several components are looked at again.
There, members of small components pair with each other if they are few; those of a crowded bucket, and
whatever shares a bucket with a component of many members, which is held against all of that component, are
compared in blocks of bounded size that give out as few links between components as connect them, not pairs. So
no link between components is passed over, and neither a large group of near copies nor a crowd of texts that
are almost near enough makes pairs. Every link is confirmed on full sets.

At 64 bands of 8, two texts of similarity 0.8 share no bucket with probability 8e-6; at 0.85, 1e-9.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import join_hot, release, stash
from ._words import BASE, MIX_A, NOT_SPACE, U, buffers, mix, shingles, words

NONE = U(0xFFFFFFFFFFFFFFFF)
#: Values that are in work at once, and bytes of text.
CHUNK = 300_000
STEP_BYTES = 1_000_000
#: Components of so many members or more are compared with the rest in blocks of BLOCK members by BLOCK others, or fewer, where these hold more than about BLOCK_SHINGLES shingles a side.
LARGE = 32
BLOCK = 1500
BLOCK_SHINGLES = 2_000_000
#: A bucket with more rows of small components than this is compared in blocks too, and ranked by size in parts of about PART rows.
CROWD = 32
PART = 20_000


def sketch(values: np.ndarray, sizes: np.ndarray, t: int) -> np.ndarray:
    """t coordinates of each of len(sizes) nonempty sets, which lie one after another in values. t: a power of two, 512 at most."""
    n, low, shift = len(sizes), U(t - 1), U(10)
    out = np.full((n, t), NONE)
    flat = out.ravel()
    live, x, row = np.arange(n), values, np.repeat(np.arange(n), sizes)
    seeds = np.arange(1, t + 1, dtype=U) * BASE
    for r in range(t):
        h = mix(x ^ seeds[r])
        np.minimum.at(flat, row * t + (h & low).astype(np.int64), (U(r) << U(54)) | (h >> shift))
        open_ = (out[live] == NONE).any(axis=1)
        if not open_.all():
            live = live[open_]
            if len(live) == 0:
                return out
            left = np.zeros(n, bool)
            left[live] = True
            keep = left[row]
            x, row = x[keep], row[keep]
    ends = np.cumsum(np.bincount(row, minlength=n))
    for i in live:
        own = x[ends[i - 1] if i else 0 : ends[i]]
        empty = np.flatnonzero(out[i] == NONE).astype(U)
        h = mix(own[:, None] ^ ((empty + U(t + 1)) * BASE)[None, :]).min(axis=0)
        out[i, empty.astype(np.int64)] = ((empty + U(t)) << U(54)) | (h >> shift)
    return out


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each row."""
    raw, offs = buffers(batch.column("text"))
    step = 0
    while step < len(batch):
        upto = max(step + 1, int(np.searchsorted(offs, offs[step] + STEP_BYTES, "right")) - 1)
        upto = min(upto, len(batch))
        hashes, counts = words(raw[offs[step] : offs[upto]], offs[step : upto + 1] - offs[step], NOT_SPACE)
        at = 0
        for c in counts:
            own = np.sort(shingles(hashes[at : at + c], k))
            at += c
            yield own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) else own
        step = upto


def _sketches(k: int, bands: int, rows: int):
    t = bands * rows
    power = np.multiply.accumulate(np.full(rows, BASE))
    seeds = mix(np.arange(1, bands + 1, dtype=U) * MIX_A)

    def flush(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(sizes)
        band: list = [None] * len(sets)
        sig = np.zeros((len(sets), 2), np.int64)
        if len(full):
            s = sketch(np.concatenate([sets[i] for i in full]), sizes[full], t)
            with np.errstate(over="ignore"):
                b = mix((s.reshape(len(full), bands, rows) * power).sum(axis=2, dtype=U) ^ seeds).view(np.int64)
            bits = np.packbits((mix(s[:, :128]) & U(1)).astype(np.uint8), axis=1)
            sig[full] = np.pad(bits, ((0, 0), (0, 16 - bits.shape[1]))).view(np.int64)
            for i, x in zip(full, b, strict=True):
                band[i] = x
        digest = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.array(digest, pa.binary()), pa.array(sig[:, 0]), pa.array(sig[:, 1]), pa.array(band, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "sig0", "sig1", "bands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, held = [], [], 0
        for batch in batches:
            for i, s in zip(batch.column("doc_id").to_pylist(), _sets(batch, k), strict=True):
                ids.append(i)
                sets.append(s)
                held += len(s) + t
                if held >= CHUNK:
                    yield flush(ids, sets)
                    ids, sets, held = [], [], 0
        if ids:
            yield flush(ids, sets)

    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets, held = [], [], 0
            for i, s in zip(batch.column("doc_id").to_pylist(), _sets(batch, k), strict=True):
                ids.append(i)
                sets.append(s.view(np.int64))
                held += len(s)
                if held >= CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["rep", "shingles"])
                    ids, sets, held = [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["rep", "shingles"])

    return run


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of x with each of y."""
    out = np.zeros((len(x), len(y)), np.float32)
    values = np.concatenate([*x, *y])
    row = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    head = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    mine = np.add.reduceat((row < len(x)).astype(np.int64), head)
    both = np.diff(np.concatenate((head, [len(values)])))
    theirs = both - mine
    dense = np.flatnonzero((mine > 0) & (theirs > 0) & (mine * theirs > 2000))
    for part in np.array_split(dense, -(-len(dense) // 512)) if len(dense) else []:
        a, b = np.zeros((len(x), len(part)), np.float32), np.zeros((len(y), len(part)), np.float32)
        for col, g in enumerate(part):
            r = row[head[g] : head[g] + both[g]]
            a[r[: mine[g]], col] = 1
            b[r[mine[g] :] - len(x), col] = 1
        out += a @ b.T
    for g in np.flatnonzero((mine > 0) & (theirs > 0) & (mine * theirs <= 2000)):
        r = row[head[g] : head[g] + both[g]]
        out[np.ix_(r[: mine[g]], r[mine[g] :] - len(x))] += 1
    return out


def _block_links(percent: int):
    """Of one block of rows (c, rep, shingles, side): links between the labels c, as few as connect what its pairs link.

    side: 0 rows are held against 1 rows; 2 rows are on both sides.
    """

    def run(block: pa.Table) -> pa.Table:
        side, c = (block.column(x).to_numpy().astype(np.int64) for x in ("side", "c"))
        sets = []
        for chunk in block.column("shingles").chunks:
            flat, ends = chunk.flatten().to_numpy(), chunk.offsets.to_numpy() - chunk.offsets[0].as_py()
            sets += [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        p, q = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        up: dict[int, int] = {}

        def root(v: int) -> int:
            while (w := up.setdefault(v, v)) != v:
                up[v] = v = up[w]
            return v

        a, b = [], []
        if len(p) and len(q):
            sizes = np.array([len(s) for s in sets])
            both = _overlaps([sets[i] for i in p], [sets[i] for i in q]).astype(np.int64)
            hit = both * 100 >= (sizes[p][:, None] + sizes[q][None, :] - both) * percent
            for i, row in zip(c[p].tolist(), hit, strict=True):
                for j in np.unique(c[q[row]]).tolist():
                    if (x := root(i)) != (y := root(j)):
                        up[x] = y
                        a.append(i)
                        b.append(j)
        return pa.table({"c": pa.array(a, pa.int64()), "d": pa.array(b, pa.int64())})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(v, component) of each vertex of edges (a, b): the smallest vertex reachable.

    Labels take the least label among neighbours, then that of the vertex they name; so paths
    halve. Each round's labels are written. Rounds grow as the logarithm of the longest path.
    """
    both = stash(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    last = stash(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("component")))
    while True:
        labels = last.select("v", "component")
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("component").alias("near"))
        least = labels.join(near, "v").select("v", F.col("component").alias("was"), F.least("component", "near").alias("c"))
        up = labels.select(F.col("v").alias("c"), F.col("component").alias("up"))
        step = stash(least.join(up, "c", "left").select("v", "was", F.least("c", "up").alias("component")))
        release(last)
        last = step
        if step.where("component <> was").isEmpty():
            release(both)
            return step.select("v", "component")


def _chunk(n: str):
    return F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")


def _every(n: str):
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _chunks(rows, shingles):
    """Into how many chunks so many rows with so many shingles are cut."""
    return F.greatest(F.ceil(rows / BLOCK), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _crowd_blocks(small: DataFrame, few: DataFrame, shingles: str = "k") -> DataFrame:
    """Rows of blocks (of, g, i, j, c, rep, side) of small (bucket, n, rep, c) in buckets of which few (bucket, k, ...) tells more than CROWD rows: each chunk of a bucket's rows against each, itself included.

    shingles: the column of few that has the sum of the rows' shingles; by itself a row has one.
    A bucket of m rows in h chunks makes m * h of them; no pairs.
    """
    crowded = stash(few.where(F.col("k") > CROWD).select("bucket", F.col("k").alias("held"), _chunks(F.col("k"), F.col(shingles)).alias("down")))
    own = join_hot(small, crowded, "bucket", "held").select("bucket", "c", "rep", _chunk("down").alias("at"), _every("down").alias("other"))
    which = F.when(F.col("at") == F.col("other"), 2).when(F.col("at") < F.col("other"), 0).otherwise(1).alias("side")
    return own.select(F.lit("bucket").alias("of"), F.col("bucket").alias("g"), F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "c", "rep", which)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 64, rows: int = 8, unique: bool | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs (doc_id, text; other columns are ignored).

    Links texts with 100 * intersection >= percent * union of their sets of k-word shingles.
    component_id: the smallest doc_id reachable by links. kept: it is the row's own.
    Null and empty texts and texts without words have no shingle and link with nothing; fewer
    words than k are one shingle. An empty table gives an empty result. Rows that repeat a doc_id, with the
    same text or another, are rows of their own and come out once each. A row without a doc_id takes part
    as any other; where none of the rows linked has one, component_id is null and kept true.
    unique: whether doc_id is known to be unique and never null; looked up if not given.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if unique is None:
        unique = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id is null or n > 1").isEmpty()
    if unique:
        return _linked_rows(docs, k, percent, bands, rows).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    # rows get keys of their own, written so that they stay the same
    own = stash(docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"))
    found = stash(_linked_rows(own.select(F.col("key").alias("doc_id"), "text"), k, percent, bands, rows).withColumnRenamed("doc_id", "key").join(own.select("key", "doc_id"), "key"))
    least = stash(found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")))
    out = join_hot(found, least, "component_id")
    return out.select("doc_id", "n_shingles", F.col("least").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("least")).alias("kept"))


def _linked_rows(docs: DataFrame, k: int, percent: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs whose doc_id is unique and never null."""
    all_ = stash(docs.mapInArrow(_sketches(k, bands, rows), "doc_id long, n_shingles long, digest binary, sig0 long, sig1 long, bands array<long>"))
    filled = all_.where("digest is not null").select("doc_id", "n_shingles", "digest")
    classes = stash(filled.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    members = stash(join_hot(filled, classes, "digest").select("doc_id", "n_shingles", "rep"))

    # (bucket, n, rep) of representatives; of buckets of one nothing is kept
    reps = stash(all_.join(classes.select(F.col("rep").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("rep"), F.col("n_shingles").cast("int").alias("n"), "bands"))
    placed = reps.select(F.explode("bands").alias("bucket"), "n", "rep")
    crowds = stash(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("held"), F.min(F.struct("n", "rep")).alias("head")).where("held > 1"))
    shared = stash(join_hot(placed, crowds, "bucket", "held"))
    release(reps, crowds)

    def as_pair(p, q):
        return F.least(p, q).alias("a"), F.greatest(p, q).alias("b")

    def near_size(p, q):
        """No link is possible beyond this ratio of sizes."""
        return F.least(p, q) * 100 >= F.greatest(p, q) * percent

    # no link is likely of two signatures that differ in so many of 128 bits: 12.8 at 0.8, where 36 is 6.8 deviations off
    odds = 128 * (1 - percent / 100) / 2
    far = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    close = far <= int(odds + 6.8 * (odds * (1 - odds / 128)) ** 0.5)

    # a representative with its bucket's least, and with its neighbour by size in its part of the bucket: parts hold PART rows or so
    part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("held") / PART))
    inner = Window.partitionBy("bucket", "part").orderBy("n", "rep")
    beside = shared.where(F.col("held") > 2).withColumn("part", part).select("n", "rep", F.lag("n").over(inner).alias("m"), F.lag("rep").over(inner).alias("q")).where("q is not null")
    heads = shared.where(F.col("rep") != F.col("head.rep")).select("n", "rep", F.col("head.n").alias("m"), F.col("head.rep").alias("q"))
    pairs = heads.union(beside).where(near_size("n", "m")).select(*as_pair("rep", "q")).distinct()

    wanted = stash(shared.select(F.col("rep").alias("doc_id")).distinct())
    full = stash(docs.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(_full_sets(k), "rep long, shingles array<long>"))
    release(wanted)

    def linked(pairs: DataFrame) -> DataFrame:
        p, q = full.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), full.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        return pairs.join(p, "a").join(q, "b").where(both * 100 >= (F.size("sa") + F.size("sb") - both) * percent).select("a", "b")

    found = components(linked(pairs))
    named = stash(shared.select("bucket", "n", F.col("rep").alias("v")).join(found, "v", "left").select("bucket", "n", F.col("v").alias("rep"), F.coalesce("component", "v").alias("c")))
    mixed = named.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("held")).where("lo < hi")
    mixed = stash(mixed.select("bucket", "held"))
    release(shared)
    large = found.groupBy(F.col("component").alias("c")).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= LARGE)
    rest = stash(join_hot(named, mixed, "bucket", "held").drop("held").join(large, "c", "left"))
    release(named, mixed)

    # components of few members, in a bucket with few of them: pairs
    small = rest.where("m is null").drop("m")
    few = stash(small.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("n").cast("long")).alias("s")))
    p = small.join(few.where(F.col("k") <= CROWD).select("bucket"), "bucket").join(all_.select(F.col("doc_id").alias("rep"), "sig0", "sig1"), "rep")
    p = stash(p.select("bucket", "n", F.col("rep").alias("a"), "c", F.col("sig0").alias("a0"), F.col("sig1").alias("a1")))
    q = p.toDF("bucket", "n2", "b", "d", "b0", "b1")
    more = p.join(q, "bucket").where((F.col("c") != F.col("d")) & (F.col("a") < F.col("b")) & near_size("n", "n2") & close)
    ends = stash(more.select("a", "b", "c", "d").distinct())
    release(p)
    by_pair = linked(ends.select("a", "b")).join(ends, ["a", "b"]).select("c", "d")

    crowd = _crowd_blocks(small, few, "s")

    # against a component of many members: blocks
    whole = rest.where("m is not null").groupBy("bucket", F.col("c").alias("d"), F.col("m").alias("dm")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    less = F.col("m").isNull() | (F.col("m") < F.col("dm")) | ((F.col("m") == F.col("dm")) & (F.col("c") < F.col("d")))
    size = (F.col("n") * 100 >= F.col("lo") * percent) & (F.col("hi") * 100 >= F.col("n") * percent)
    probes = rest.join(whole, "bucket").where((F.col("c") != F.col("d")) & less & size)
    probes = stash(probes.select("d", "dm", "c", "rep", "n").distinct())
    cells = probes.groupBy("d", "dm").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("n").cast("long")).alias("s"))
    sizes = rest.where("m is not null").groupBy(F.col("c").alias("d")).agg(F.max(F.col("n").cast("long")).alias("most"))
    cells = stash(cells.join(sizes, "d").select("d", _chunks(F.col("dm"), F.col("dm") * F.col("most")).alias("across"), _chunks(F.col("k"), F.col("s")).alias("down")))
    blocks = [probes.drop("dm", "n").join(cells, "d").select("d", _chunk("down").alias("i"), _every("across").alias("j"), "c", "rep", F.lit(0).alias("side"))]
    theirs = found.select(F.col("component").alias("d"), F.col("component").alias("c"), F.col("v").alias("rep")).join(cells, "d")
    blocks.append(theirs.select("d", _every("down").alias("i"), _chunk("across").alias("j"), "c", "rep", F.lit(1).alias("side")))
    for part_ in blocks:
        crowd = crowd.union(part_.select(F.lit("component").alias("of"), F.col("d").alias("g"), "i", "j", "c", "rep", "side"))
    by_block = crowd.join(full, "rep").groupBy("of", "g", "i", "j").applyInArrow(_block_links(percent), "c long, d long")
    joined = by_pair.union(by_block).distinct().select(F.col("c").alias("a"), F.col("d").alias("b"))
    over = components(joined).select(F.col("v").alias("component"), F.col("component").alias("top"))
    release(full, rest, few, ends, probes, cells)
    final = found.join(over, "component", "left").select("v", F.coalesce("top", "component").alias("c"))
    # a representative without a link in the first round may have one in the second
    alone = over.select(F.col("component").alias("v"), F.col("top").alias("c")).join(found.select("v"), "v", "left_anti")
    named_reps = stash(classes.join(final.union(alone).withColumnRenamed("v", "rep"), "rep").select("rep", "n", "c"))
    out = join_hot(members, named_reps, "rep", how="left").select("doc_id", "n_shingles", F.coalesce("c", "rep").alias("component_id"))
    return out.union(all_.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op4_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    from ._common import table

    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


QUERIES = {"op4_minhash_near_dedup": op4_minhash_near_dedup}
ORACLES: dict[str, str] = {}
