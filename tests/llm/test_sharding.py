import zlib
from collections import Counter, defaultdict

from pagewright.llm.sharding import op10_balanced_label_propagation, shard_documents
from tests.conftest import DATA_01


def check(rows, docs, n_shards):
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in docs)
    text = dict(docs)
    slots = defaultdict(list)
    for r in rows:
        b = (text[r.doc_id] or "").encode()
        assert r.size == len(b) + 1 and r.text_crc32 == zlib.crc32(b)
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(n_shards)]
    assert set(slots) <= set(range(n_shards)) and max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    places = defaultdict(set)
    for r in rows:
        if text[r.doc_id] is not None:
            places[text[r.doc_id]].add(r.shard)
    return {t: len(s) for t, s in places.items()}


def test_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA_01}/documents.parquet").collect()]
    rows = op10_balanced_label_propagation(spark, DATA_01).collect()
    assert max(check(rows, docs, 8).values()) == 1
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_hot_group_and_edges(spark):
    docs = [(i, "hot") for i in range(400)] + [(400 + i, f"pair {i // 2}") for i in range(300)] + [(700 + i, f"t{i}") for i in range(300)]
    docs += [(2000, None), (2001, None), (2002, ""), (2003, ""), (2004, "é" * 50_000)]
    d = spark.createDataFrame([(i, t, 5, "h") for i, t in docs], "doc_id long, text string, shard int, hub string")
    split = check(shard_documents(d, 8).collect(), docs, 8)
    assert split["hot"] == 4 and sum(n > 1 for t, n in split.items()) <= 2
    assert check(shard_documents(d, 3).collect(), docs, 3)
    assert check(shard_documents(d.where("doc_id = 2000"), 8).collect(), docs[1000:1001], 8) == {}
    assert shard_documents(d.where("false"), 8).collect() == []


def test_hot_group_over_many_shards(spark):
    """A hot text fills shards, one a round, for as many rounds as it takes."""
    docs = [(i, "hot") for i in range(54)] + [(54 + i, f"t{i}") for i in range(54)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert check(shard_documents(d, 36).collect(), docs, 36)["hot"] == 18


def twin(start, links, room, n_shards, hashes, pair_hashes):
    """propagate(), step by step: start {(unit, shard): m}, links {(a, b): w} in both directions."""
    from pagewright.llm._common import rank_buckets

    sizes = Counter()
    for (u, _), m in start.items():
        sizes[u] += m

    def cut(labels):
        own = {u: [m for (v, _), m in labels.items() if v == u] for u in sizes}
        total = sum((sizes[u] ** 2 - sum(m * m for m in own[u])) / 2 for u in sizes)
        for (a, b), w in links.items():
            if a < b:
                total += w * (1 - sum(labels.get((a, s), 0) / sizes[a] * labels.get((b, s), 0) / sizes[b] for s in range(n_shards)))
        return round(total)

    def votes(labels):
        v = Counter({k: 1000 * m for k, m in labels.items()})
        for (a, b), w in links.items():
            for s in range(n_shards):
                if m := labels.get((b, s)):
                    v[a, s] += int(w * m * 1000 / sizes[b])
        return v

    def seat(v):
        done, free, moves = dict.fromkeys(sizes, 0), [room] * n_shards, defaultdict(list)
        buckets = rank_buckets(len(sizes))
        while max(free) > 0 and (left := [u for u in sizes if done[u] < sizes[u]]):
            largest, asked = max(free), defaultdict(list)
            for u in left:
                w = sizes[u] - done[u]
                s = max((v.get((u, s), 0), pair_hashes[u, s], s) for s in range(n_shards) if free[s] >= min(w, largest))[2]
                asked[s].append(((63 - (w.bit_length() - 1)) * buckets + hashes[u] % buckets, w, u))
            for s, own in asked.items():
                ahead = 0
                room_left = free[s]
                for _, w, u in sorted(own):
                    allowed = room_left - ahead
                    part = w if allowed >= w else max(allowed, 0) if w > largest else 0
                    ahead += w
                    if part:
                        done[u] += part
                        free[s] -= part
                        moves[u].append((s, part))
        labels = Counter()
        for u, n in sizes.items():
            for s, part in moves[u]:
                labels[u, s] += part
            if n > done[u]:
                labels[u, min(s for (w, s) in start if w == u)] += n - done[u]
        return labels

    labels, cuts, first = dict(start), [cut(start)], True
    while first or cuts[-1] > 0:
        tried = seat(votes(labels))
        if not first and cut(tried) >= cuts[-1]:
            break
        labels, first = tried, False
        cuts.append(cut(tried))
    return {k: m for k, m in labels.items() if m}, cuts


def test_propagation_against_a_slow_twin(spark):
    import random

    from pagewright.llm import sharding as S

    rnd = random.Random(3)
    for n_shards, n_units, room in ((4, 60, 90), (8, 40, 30), (3, 30, 45)):
        start, links = {}, {}
        for u in range(n_units):
            for _ in range(rnd.choice([1, 2, 3, 9, 20 if u % 9 == 0 else 2])):
                k = (u, rnd.randrange(n_shards))
                start[k] = start.get(k, 0) + 1
        for _ in range(n_units * 2):  # chains of units that belong together
            a = rnd.randrange(n_units - 1)
            b = min(n_units - 1, a + rnd.randrange(1, 4))
            w = links.get((a, b), 0) + 1
            links[a, b] = links[b, a] = w
        first = spark.createDataFrame([(u, s, m) for (u, s), m in start.items()], "unit long, shard int, m long")
        tied = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "a long, b long, w long")
        keys = spark.range(n_units).selectExpr("id as unit", "xxhash64(id) as h").collect()
        pairs = spark.range(n_units).selectExpr("id as unit", f"explode(sequence(0, {n_shards - 1})) as shard").selectExpr("unit", "shard", "xxhash64(unit, shard) as h").collect()
        for given, known in ((tied, links), (None, {})):
            moves, cut = S.propagate(first, given, room, n_shards)
            got = {(r.unit, r.shard): r.m for r in S._labels_after(moves, first).collect()}
            want, cuts = twin(start, known, room, n_shards, {r.unit: r.h for r in keys}, {(r.unit, r.shard): r.h for r in pairs})
            assert cut == cuts and got == want
            assert cut[-1] < cut[0]


def test_edges_between_documents(spark):
    docs = [(i, f"text {i}") for i in range(200)] + [(500, None), (501, None), (502, "text 3")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    ring = [(i, i + 1) for i in range(200) if i % 10 < 9 and i < 199] + [(500, 501), (500, 0), (7, 9999), (None, 3), (5, 5)]
    edges = spark.createDataFrame(ring, "a long, b long")
    from pagewright.llm.sharding import balance

    out = balance(d, 4, edges)
    rows = out.rows.collect()
    check(rows, docs, 4)
    shard = {r.doc_id: r.shard for r in rows}
    hashed = {r.doc_id: r.s for r in d.selectExpr("doc_id", "pmod(xxhash64(doc_id), 4) as s").collect()}
    pairs = [(a, b) for a, b in ring if a in shard and b in shard]
    assert out.cut == sorted(out.cut, reverse=True) and len(out.cut) > 2
    assert sum(shard[a] != shard[b] for a, b in pairs) < 0.5 * sum(hashed[a] != hashed[b] for a, b in pairs)
    assert shard[3] == shard[502]
