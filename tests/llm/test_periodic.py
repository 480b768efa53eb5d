import hashlib
import random
import zlib

import numpy as np
import pytest

from __spark_entry__ import queries
from seatmeter.llm import periodic as q
from tests.llm.cases import SF, edge_docs, words


def smallest_period(w):
    border = [0] * len(w)
    k = 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = border[k - 1]
        k += w[i] == w[k]
        border[i] = k
    return len(w) - border[-1]


def brute(w):
    """(start, length, period) of all runs, trying every period at every place."""
    out = []
    for p in range(1, len(w) // 2 + 1):
        same = np.zeros(len(w) - p + 2, dtype=np.int8)
        same[1:-1] = [a == b for a, b in zip(w, w[p:])]
        edges = np.flatnonzero(np.diff(same))
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if j - i + p >= max(12, 2 * p) and smallest_period(w[i:j + p]) == p:
                out.append((i, j - i + p, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def sequences(kind, rng):
    if kind == "binary":
        return [rng.randint(0, 1) for _ in range(rng.randint(0, 200))]
    if kind == "fibonacci":
        a, b = [0], [0, 1]
        while len(b) < 300:
            a, b = b, b + a
        return b[:rng.randint(1, 300)]
    if kind == "thue-morse":
        return [bin(i).count("1") & 1 for i in range(rng.randint(1, 300))]
    if kind == "one letter":
        w = [0] * rng.randint(1, 150)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = 1
        return w
    if kind == "regions":                              # periodic regions side by side, repeated
        r = rng.randint(1, 4)
        root = [rng.randint(0, 1) for _ in range(r)] * 100
        side = lambda: root[rng.randint(0, r):][:rng.randint(9, 90)]
        return (side() + side()) * rng.randint(1, 3)
    if kind == "powers":
        root = [rng.randint(0, 3) for _ in range(rng.randint(1, 70))]
        return [9] * rng.randint(0, 20) + (root * 60)[:rng.randint(1, 400)] + [8] * rng.randint(0, 3)
    return [rng.randint(0, 40) for _ in range(rng.randint(0, 200))]


@pytest.mark.parametrize("kind", ["binary", "fibonacci", "thue-morse", "one letter", "regions", "powers", "prose"])
def test_runs_against_every_period(kind):
    rng = random.Random(kind)
    for _ in range(25):
        texts = [sequences(kind, rng) for _ in range(rng.randint(1, 4))]
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(sizes + 1) - sizes - 1
        joined = np.concatenate([np.array(t + [1000 + k], dtype=np.int64) for k, t in enumerate(texts)])
        found = sorted(map(tuple, q.found_runs(joined, starts, sizes).tolist()))
        assert found == sorted((s + i, s + i + n - 1, p) for t, s in zip(texts, starts.tolist()) for i, n, p in brute(t))


def test_long_periods_and_a_long_text():
    rng = np.random.default_rng(2)
    root = rng.integers(0, 50, 9_001)
    w = np.concatenate([rng.integers(0, 50, 777), np.tile(root, 4)[:30_000], [60], np.tile([1, 2, 3], 3000)])
    found = q.found_runs(np.append(w, 99), np.array([0]), np.array([len(w)])).tolist()
    assert [777, 30_776, 9_001] in [[s, e, p] for s, e, p in found if p == 9001] and len(found) == 2
    assert [30_778, 39_777, 3] in found


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = {r.doc_id: r for r in queries()["op11_periodic_runs"](spark, SF).collect()}
    assert len(found) == len(docs)
    planted = 0
    for d in docs:
        w = words(d.text)
        h, n = zlib.crc32(str(d.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        if n > 1500 and planted > 3:
            continue
        runs, r = brute(w), found[d.doc_id]
        lines = "".join(f"{s},{k},{p}\n" for s, k, p in runs)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        assert (r.n_runs, r.n_words) == (len(runs), n)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
    assert planted > 5


def test_edges(spark, monkeypatch):
    docs = edge_docs(spark)
    rows = q.periodic_runs(docs).collect()
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        text = next(t for i, t in texts if i == r.doc_id)
        w = words(text)
        runs = [(0, 30_000, 1)] if r.doc_id == 9 else brute(w)
        assert [tuple(x) for x in r.runs] == runs and r.collapsed == collapsed(w, runs) and r.n_words == len(w)
    assert q.periodic_runs(edge_docs(spark, [])).count() == 0
    assert q.numbered("a " * 3 + " b", q.defaultdict(q.count().__next__)).tolist() == [0, 0, 0, 1]


def test_long_blanks_and_words():
    numbers = q.defaultdict(q.count().__next__)
    text = " " * 3_000_000 + "x" * 3_000_000 + "\n" * 2_000_000 + "y " * 700_000
    found = q.numbered(text, numbers)
    assert found.tolist() == [0] + [1] * 700_000 and len(numbers) == 2
    runs = q.found_runs(np.append(found, 2), np.array([0]), np.array([len(found)]))
    assert runs.tolist() == [[1, 700_000, 1]]
