import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatmeter.llm import mil as q
from tests.llm.cases import GOOD, edge_docs

BIG = "/root/testdata/sf0.01"


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    x, starts, y = rng.normal(size=(7, q.FEATURES)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])
    w = q.fit([x[:3], x[3:4], x[4:]], y).weights

    def loss():
        p = q._forward(w, x, starts)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    got = q._gradients(w, x, starts, y)
    for name, g in got.items():
        place = np.unravel_index(np.abs(g).argmax(), g.shape)
        w[name][place] += 1e-6
        up = loss()
        w[name][place] -= 2e-6
        down = loss()
        w[name][place] += 1e-6
        assert (up - down) / 2e-6 == pytest.approx(g[place], rel=1e-3, abs=1e-7)


def test_passages_cover_whole_texts():
    assert q.passages(None).shape == q.passages(b" \n").shape == (1, q.FEATURES)
    assert len(q.passages(b"word " * 801)) == 11
    tail = b"word " * 800
    assert not np.array_equal(q.passages(tail + b"one"), q.passages(tail + b"###"))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    report = q.quality_report(docs, labels)
    assert report.count() == docs.count()
    rows = report.join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 80 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == r.quality for r in held) / len(held) >= 0.97
    clean = [r for r in held if r.quality == 1]
    assert sum(r.predicted for r in clean) / len(clean) >= 0.97


def test_held_out_labels_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet").limit(300) for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", q.F.when(q.remainder("doc_id", 3) == 1, 1 - labels.quality).otherwise(labels.quality))
    a, b = ({r.doc_id: r.score for r in q.quality_report(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 1), (2, 1), (13, 1), (9, 0), (11, 0), (12, 0), (10, None), (None, 0), (7, 5)],
                                   "doc_id long, quality int")
    scores = {}
    for r in q.scored(docs, labels, into="p").collect():
        assert 0 <= r.p <= 1
        scores.setdefault(r.text, set()).add(r.p)
    assert all(len(s) == 1 for s in scores.values())
    assert q.scored(docs, labels, into="p").columns == [*docs.columns, "p"]
    assert q.rejected_removed(docs, labels).columns == docs.columns
    assert q.quality_report(edge_docs(spark, []), labels).count() == 0


def test_without_labels(spark):
    docs = edge_docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in q.quality_report(docs, none).collect()} == {0.5}
    assert q.rejected_removed(docs, none).count() == docs.count()


def test_sample_is_bounded(spark):
    docs = edge_docs(spark, [(i, GOOD, "en", "a") for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    sample = q.labelled_sample(docs, labels, "doc_id", "text", "quality", 10)
    assert sample.count() == 10 and sample.where(q.remainder("key", 3) == 1).count() == 0


def test_copies_do_not_push_out_the_sample(spark):
    """Copies of one row, in the documents and in the labels, take one place in a small sample each."""
    free = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    hash_of = {r.i: r.h for r in spark.createDataFrame([(i,) for i in free], "i long").select(
        "i", F.xxhash64("i").alias("h")).collect()}
    hot = min(free, key=hash_of.get)
    rows = [(i, f"text {i}") for i in free] + [(hot, f"text {hot}")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(free)] + [(hot, free.index(hot) % 2)] * 500,
                                   "doc_id long, quality int")
    sample = q.labelled_sample(docs, labels, "doc_id", "text", "quality", 40).collect()
    assert len(sample) == 40 and len({r.key for r in sample}) == 40
    assert q.learned(docs, labels, max_labels=40) is not None


def test_one_passage_of_many_decides(spark):
    """A document is bad if one of its passages is. The attention falls on that passage, and shuffled ones score alike."""
    rng = np.random.default_rng(8)
    prose = "the house of our north stands by a water and in winter people walk to it for their view".split()
    def bag(bad, size):
        parts = [" ".join(rng.choice(prose, q.PASSAGE_WORDS)) for _ in range(size)]
        if bad:
            parts[rng.integers(size)] = " ".join(rng.choice(["##$$%%", "!!||!!", "&&<>##", "$#%|"], q.PASSAGE_WORDS))
        return q.passages(" ".join(parts).encode())
    bad = rng.random(300) < 0.5
    bags = [bag(b, int(rng.integers(8, 20))) for b in bad]
    model = q.fit(bags[:200], 1.0 - bad[:200])
    right = 0
    for b, x in zip(bad[200:], bags[200:]):
        got = q._forward(model.weights, (x - model.mean) / model.scale, np.array([0]))
        right += (got["p"][0] < 0.5) == b
        if b:
            odd = int(x[:, q._KIND[ord("#")]].argmax())
            assert got["a"].argmax() == odd and got["a"][odd] > 3 / len(x)
    assert right >= 97


def test_long_labelled_texts_are_learned_from(spark):
    """Texts of 240,000 to 300,000 characters, and a bag of bounded size whatever the text."""
    rows = [(i, (GOOD + " ") * (1500 + 9 * i) if i % 2 else "#### $$$$ spam " * (17_000 + 90 * i), "en", "a") for i in range(40)]
    docs = edge_docs(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert q.labelled_sample(docs, labels, "doc_id", "text", "quality", 100).count() > 20
    report = {r.doc_id: r.predicted for r in q.quality_report(docs, labels).collect()}
    assert report == {i: i % 2 for i in range(40)}
    long = q.passages(b"word " * 1_000_000)
    assert len(long) == q.PASSAGES
    tail = b"word " * 999_000
    assert not np.array_equal(q.passages(tail + b"one " * 1000)[-1], q.passages(tail + b"### " * 1000)[-1])
