import numpy as np
import xxhash
from pyspark.sql import functions as F

from seatmeter.llm import simhash as q
from seatmeter.llm.components import components
from tests.llm.cases import GOOD, SF, edge_docs, lowered, words


def brute_print(text):
    w = words(lowered(text))
    shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute_components(pairs, distance=4):
    """{place: smallest id} of (id, fingerprint) pairs."""
    root = list(range(len(pairs)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, (id_, _) in enumerate(pairs):
        groups.setdefault(find(i), []).append(id_)
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(pairs))]


def test_fingerprints_and_components_of_edges(spark):
    docs = edge_docs(spark)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in q.near_duplicates(docs).collect()), key=str)
    pairs = [(r.doc_id, brute_print(r.text)) for r in docs.collect()]
    want = [(i, f"{p:016x}", c) for (i, p), c in zip(pairs, brute_components(pairs))]
    assert got == sorted(want, key=str)
    assert {r[2] for r in got if r[0] in (3, 4, 5)} == {3} and got[0][1] is not None


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    pairs = [(r.doc_id, brute_print(r.text)) for r in rows]
    want = {i: c for (i, _), c in zip(pairs, brute_components(pairs))}
    assert {r.doc_id: r.component_id for r in q.near_duplicates(docs).collect()} == want


def joined(points, edges):
    root = {p: p for p in points}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {p: find(p) for p in points}


def test_many_shards_lose_no_link(spark):
    """Random points with planted neighbours at every distance up to 5, a chain and a dense ball."""
    rng = np.random.default_rng(3)
    points = [int(x) for x in rng.integers(0, 1 << 63, 1500)]
    for p in points[:300]:
        for bits in range(1, 6):
            points.append(p ^ int(sum(1 << int(b) for b in rng.choice(63, bits, replace=False))))
    points += [points[0] ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (400, 2))]
    points = sorted(set(points))
    a = np.array(points, dtype=np.uint64)
    close = np.argwhere(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= 4, 1))
    want = joined(points, [(points[i], points[j]) for i, j in close])
    prints = spark.createDataFrame([(p,) for p in points], "fp long")
    for shard_points, shard_pairs in ((64, 1 << 28), (64, 2000), (1 << 20, 1 << 28)):
        found = q.links(prints, shard_points=shard_points, shard_pairs=shard_pairs)
        assert joined(points, [(r.u, r.v) for r in found.collect()]) == want


def test_in_memory_division(monkeypatch):
    monkeypatch.setattr(q, "LEAF_PAIRS", 256)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 800).astype(np.uint64)
    near = base[:200] ^ np.uint64(0b101100000000000000000000000000000000000001)
    points = np.unique(np.concatenate([base, near]))
    every = np.arange(len(points))
    found = [q.Links(points) for _ in range(2)]
    found[0].compare(every, every, 4)
    for mask in q.block_masks(3):
        found[1].search(every, every, every[:0], mask, 1, 4)
    assert np.array_equal(found[0].root, found[1].root)


def test_one_row_of_each_group_stays(spark):
    docs = edge_docs(spark)
    kept = q.near_duplicates_removed(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and None in ids and ids.count(3) == 1 and 4 not in ids
    groups = {r.component_id for r in q.near_duplicates(docs.where("doc_id is not null")).collect()}
    assert {i for i in ids if i is not None} == groups


def test_rows_without_ids(spark):
    docs = edge_docs(spark, [(None, GOOD, "en", "a"), (None, GOOD, "en", "a")])
    assert [r.component_id for r in q.near_duplicates(docs).collect()] == [None, None]
    assert q.near_duplicates_removed(docs).count() == 1


def test_empty(spark):
    docs = edge_docs(spark, [])
    assert q.near_duplicates(docs).count() == 0 and q.near_duplicates_removed(docs).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = {r.u: r.v for r in components(edges.union(edges)).collect()}
    assert got == {i: 0 for i in range(1, 301)}
