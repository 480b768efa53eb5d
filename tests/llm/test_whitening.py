import math

import numpy as np
import pytest

from __spark_entry__ import queries
from seatmeter.llm import whitening as q
from tests.llm.cases import SF


def expected(rows, wanted=16):
    """Plain numpy: {(vec_id, deviation): whitened up to sign}, the sums and the explained shares."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
    out = []
    for i, x in kept:
        x = np.array(x, dtype=np.int64)
        out.append((i, sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums)),
                    (x - sums / n) @ vectors / np.sqrt(values)))
    return n, out, values / np.trace(centred.T @ centred / n)


def test_query_against_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    n, want, explained = expected(rows)
    found = {}
    for r in queries()["op12_embedding_whitening"](spark, SF).collect():
        found[r.vec_id, r.component] = r
    assert len(found) == 16 * len(want)
    sign = [math.copysign(1, found[want[0][0], k + 1].whitened * want[0][2][k]) for k in range(16)]
    for vec_id, deviation, white in want:
        for k in range(16):
            r = found[vec_id, k + 1]
            assert (r.n, r.deviation) == (n, deviation) and r.identity_error < 1e-9
            assert r.whitened == pytest.approx(sign[k] * white[k], abs=1e-7)
            assert r.explained == pytest.approx(explained[k], rel=1e-9)


@pytest.mark.parametrize("kind", ["random", "diagonal", "cluster", "rank", "tiny", "pair", "split"])
def test_decomposition(kind):
    rng = np.random.default_rng(3)
    basis = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    a = {"random": lambda: np.cov(rng.standard_normal((30, 90))),
         "diagonal": lambda: np.diag(np.arange(30.0)),
         "cluster": lambda: basis @ np.diag([5.0] * 4 + [5 + 1e-12] * 3 + [1.0] * 20 + [0.5] * 3) @ basis.T,
         "rank": lambda: basis[:, :3] @ np.diag([9.0, 4.0, 1.0]) @ basis[:, :3].T,
         "tiny": lambda: np.array([[3.0]]), "pair": lambda: np.array([[2.0, 1.0], [1.0, 2.0]]),
         "split": lambda: np.kron(np.eye(6), np.cov(rng.standard_normal((5, 40))))}[kind]()
    values, vectors = q.components(a, 16)
    truth = np.linalg.eigvalsh(a)[::-1][:16]
    truth = truth[truth > 1e-11 * truth[0]]
    assert values == pytest.approx(truth, rel=1e-11)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * np.abs(a).max() * len(a)


def test_sturm_count():
    d, e = np.array([2.0, 0.0, -1.0, 4.0]), np.array([1.0, 0.0, 2.0])
    truth = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.linspace(-6, 7, 40)
    assert q.smaller(d, e, at).tolist() == [int((truth < x).sum()) for x in at]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows],
                                 "vec_id long, embedding array<float>, n int, key string, x double")


def test_edges(spark):
    rng = np.random.default_rng(5)
    good = [(k, [float(c) for c in rng.standard_normal(4)]) for k in range(60)]
    rows = good + [(7, good[7][1]), (None, good[8][1]), (100, None), (101, []), (102, [1.0, None, 2.0, 0.0]),
                   (103, [float("nan"), 1.0, 1.0, 1.0]), (104, [float("inf"), 1.0, 1.0, 1.0]),
                   (105, [1.0, 2.0]), (106, [1e30, 0.0, 0.0, 0.0])]
    found = q.whitened(frame(spark, rows), wanted=3).collect()
    n, want, _ = expected(rows[:62], 3)
    assert n == 60 and len(found) == 62 * 3 and {r.n for r in found} == {60}
    assert sorted((str(r.vec_id), int(r.deviation)) for r in found if r.component == 1) == sorted(
        (str(i), d) for i, d, _ in want)
    assert len([r for r in found if r.vec_id is None]) == 3


def test_long_sums_stay_exact():
    centre = q.Centre(3_000_000_000, [3 * 10 ** 15 + 1, 7])
    x = np.array([[2 ** 38, 1], [-5, 0]], dtype=np.int64)
    assert centre.deviation(x) == [sum((centre.n * int(a) - s) ** 2 for a, s in zip(row, centre.sums)) for row in x]
    near = q.Centre(10, [10_000_003, -7])
    x = np.array([[1_000_001, 3], [999_999, -2]], dtype=np.int64)
    assert near.deviation(x) == [sum((10 * int(a) - s) ** 2 for a, s in zip(row, near.sums)) for row in x]


def test_empty_equal_and_flat(spark):
    assert q.whitened(frame(spark, [])).count() == 0
    assert q.whitened(frame(spark, [(1, [1.0, 2.0])] * 5)).count() == 0
    flat = q.whitened(frame(spark, [(k, [float(k), 3.0]) for k in range(6)])).collect()
    assert len(flat) == 6 and {r.component for r in flat} == {1}
    assert sum(r.whitened ** 2 for r in flat) == pytest.approx(6)
    assert all(r.explained == pytest.approx(1) for r in flat)
