import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatmeter.llm import topk as q


def brute(rows, asks, k):
    """rows: (id, vector) with positions; the k best other rows of each query row."""
    good = [(p, i, [math.floor(256 * float(x)) for x in v]) for p, (i, v) in enumerate(rows)
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for p, i, v in good:
        if asks(i):
            near = sorted((-sum(a * b for a, b in zip(v, w)), j) for o, j, w in good if o != p and len(w) == len(v))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near[:k])]
    return sorted(out)


def found(spark, rows, k=5, **kw):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, row int, x int")
    return sorted(map(tuple, q.top_k(df, F.col("vec_id") % 5 == 0, k, **kw).collect()))


def vectors(n, width, seed, scale=1.0):
    return np.random.default_rng(seed).normal(0, scale, (n, width)).astype(np.float32).tolist()


@pytest.mark.parametrize("width,scale", [(1, 1.0), (3, 0.004), (16, 0.2), (8, 900.0)])
@pytest.mark.parametrize("block_rows", [50, 1 << 14])
def test_matches_brute_force(spark, width, scale, block_rows):
    rows = list(enumerate(vectors(230, width, width, scale)))
    assert found(spark, rows, block_rows=block_rows, query_rows=20) == brute(rows, lambda i: i % 5 == 0, 5)


def test_ties_go_to_smaller_ids(spark):
    """A third of all rows share one vector."""
    rows = [(i, [0.5, 0.25]) if i % 3 else (i, v) for i, v in enumerate(vectors(180, 2, 1, 0.3))][::-1]
    for block_rows in (16, 1000):
        assert found(spark, rows, block_rows=block_rows) == brute(rows, lambda i: i % 5 == 0, 5)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]),
            (None, [9.0, 9.0]), (5, [0.5, 0.5]), (5, [0.5, 0.5]), (6, [1.0]), (10, []), (11, []), (7, [0.0, 0.0])]
    got = found(spark, rows)
    assert got == brute(rows, lambda i: i % 5 == 0, 5)
    assert [r for r in got if r[0] == 10] == [(10, 1, 11, 0)]
    assert found(spark, []) == [] and found(spark, [(1, [1.0])]) == [] and found(spark, [(5, [1.0])]) == []


def test_large_components(spark):
    """Quantised components up to 2^62 take part; scores beyond a long are the nearest long, and ties there."""
    rows = [(0, [1e17, 1.0]), (5, [1e15, 1.0]), (1, [1e15, 3.0]), (2, [-1e15, 0.0]), (3, [1.0, 2.0]), (4, [0.0, 1.0])]
    got = found(spark, rows, k=9)
    assert all(0 not in (r[0], r[2]) for r in got) and {r[0] for r in got} == {5}
    assert [r[2] for r in got] == [1, 3, 4, 2] and got[0][3] == 2 ** 63 - 1 and got[-1][3] == -2 ** 63


def test_an_index_is_built_once_and_read_back(spark):
    x = np.random.default_rng(3).integers(-70, 90, (150, 5))
    block = q.SlicedBlock(x)
    again = q.SlicedBlock.unpacked(block.packed(), 150, 5, block.low, block.bits)
    for query in x[:20]:
        assert again.top(query, 7) == block.top(query, 7)


def test_slices_hold_the_scores():
    rng = np.random.default_rng(0)
    x, query = rng.integers(-300, 200, (130, 9)), rng.integers(-99, 99, 9)
    slices, shift = q.SlicedBlock(x).scores(query)
    bits = np.stack([np.unpackbits(s.view(np.uint8), bitorder="little") for s in slices])
    totals = (bits.astype(object) * np.array([1 << k for k in range(len(slices))], dtype=object)[:, None]).sum(axis=0)
    assert [int(t) - shift for t in totals[:130]] == (x @ query).tolist()
