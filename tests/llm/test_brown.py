import math
import zlib
from collections import Counter

import numpy as np
import pytest

from seatmeter.llm import brown as q
from tests.llm.cases import SF, edge_docs, lowered, words

END = None


def tokens(text):
    return [*words(lowered(text)), END]


def brute(rows):
    train = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            train.update(tokens(t))
    n, v = sum(train.values()), len(train)
    for i, t in rows:
        w = tokens(t)
        yield (str(i), i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(w), sum(train[x] > 0 for x in w), n,
               sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))


@pytest.mark.parametrize("source", ["edges", "table"])
@pytest.mark.parametrize("dictionary", [5, 200_000])
def test_base_score_matches_brute_force(spark, source, dictionary):
    docs = edge_docs(spark) if source == "edges" else spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score)
                 for r in q.lm_scores(docs, clustered=4, classes=2, dictionary=dictionary).collect())
    want = sorted(brute([(r.doc_id, r.text) for r in docs.collect()]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])


def test_score_does_not_depend_on_the_dictionary(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    small, large = ({r.doc_id: r.score for r in q.lm_scores(docs, clustered=50, classes=8, dictionary=d).collect()}
                    for d in (60, 200_000))
    assert small == pytest.approx(large)


def test_classes_beat_the_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = q.lm_scores(docs).where("held_out").selectExpr("sum(score)", "sum(base_score)", "sum(n_tokens)").first()
    assert sums[0] > sums[1] + 0.1 * sums[2]


def test_probabilities_sum_to_one(spark):
    """Over all words with a count and one unseen word per shape, after any class."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(q.F.col("text").cast("binary").alias("text"))
    counts = q.word_counts(docs).cache()
    model = q.learned(docs, counts, clustered=100, classes=10, dictionary=10 ** 6)
    lexicon = model.lexicon
    per_class = np.bincount(model.classes[lexicon.state], weights=10 ** model.emission, minlength=len(model.transition))
    for k in range(q.SHAPES):
        per_class[model.classes[lexicon.clustered + k]] += 0.5 / 10 ** model.shape_loss[k]
    per_class[model.classes[lexicon.end]] += 1
    used = np.flatnonzero(np.bincount(model.classes))
    assert np.allclose(per_class[used], 1)
    assert np.allclose((10 ** model.transition).sum(axis=1), 1, atol=1e-3)


def test_exchange_raises_the_likelihood_and_finds_classes():
    """Words 0-5 alternate between two groups: group members follow only members of the other."""
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in zip(rng.integers(0, 3, 3000) * 2, rng.integers(0, 3, 3000) * 2 + 1)]
    pairs += [(b, a) for a, b in pairs]
    count = Counter(pairs)
    first, second = (np.array([p[k] for p in sorted(count)]) for k in (0, 1))
    n = np.array([count[p] for p in sorted(count)], dtype=float)
    cls = q.exchanged(first, second, n, 6, 7, classes=2)
    assert len({cls[w] for w in (0, 2, 4)}) == 1 and len({cls[w] for w in (1, 3, 5)}) == 1 and cls[0] != cls[1]
    assert cls[6] == 2


def test_empty_and_untrained(spark):
    assert q.lm_scores(edge_docs(spark, [])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = q.lm_scores(edge_docs(spark, [(held, "one two", "en", "a")])).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0) and row.score <= 0


def likelihood(first, second, n, cls):
    size = int(cls.max()) + 1
    between = np.bincount(cls[first] * size + cls[second], weights=n, minlength=size * size).reshape(size, size)
    return q._xlogx(between).sum() - q._xlogx(between.sum(axis=0)).sum() - q._xlogx(between.sum(axis=1)).sum()


def test_gains_are_differences_of_the_likelihood():
    """In closed chains, where every word is as often first as second. State 9 is the end, of class 4."""
    rng = np.random.default_rng(1)
    way = np.concatenate([[9], rng.integers(0, 9, 300), [9]])
    count = Counter(zip(way[:-1].tolist(), way[1:].tolist()))
    first, second = (np.array([p[k] for p in count]) for k in (0, 1))
    n = np.array(list(count.values()), dtype=float)
    cls = np.append(np.arange(9) % 4, 4)
    between = np.bincount(cls[first] * 5 + cls[second], weights=n, minlength=25).reshape(5, 5)
    for w in range(9):
        after, before = (np.bincount(cls[b[(a == w) & (b != w)]], weights=n[(a == w) & (b != w)], minlength=5)[None]
                         for a, b in ((first, second), (second, first)))
        gain = q.gains(between, after, before, n[(first == w) & (second == w)].sum(keepdims=True), cls[[w]])[0]
        want = [likelihood(first, second, n, np.where(np.arange(10) == w, c, cls)) for c in range(4)]
        assert gain - gain[0] == pytest.approx(np.array(want) - want[0])


@pytest.mark.parametrize("dictionary", [15, 1000])
def test_words_beyond_the_head_get_classes(spark, dictionary):
    """Frequent words h stand between a and b, g between b and a; so do twenty rare words x and twenty y."""
    rng = np.random.default_rng(2)
    pick = lambda often, seldom: f"{often}{rng.integers(4)}" if rng.random() < 0.7 else f"{seldom}{rng.integers(20)}"
    texts = [(" ".join(f"a {pick('h', 'x')} b {pick('g', 'y')}" for _ in range(50)).encode(),) for _ in range(40)]
    docs = spark.createDataFrame(texts, "text binary")
    model = q.learned(docs, q.word_counts(docs).cache(), clustered=10, classes=4, dictionary=dictionary)
    got = {w.decode(): int(model.classes[k]) for w, k in model.lexicon.place.items()}
    got |= {r.word: r["class"] for r in model.beyond.collect()}
    assert len(got) == 50 and (model.beyond.count() > 20) == (dictionary < 50)
    h, g = ({got[f"{s}{i}"] for i in range(4)} for s in "hg")
    x, y = ([c for i in range(20) if (c := got[f"{s}{i}"]) < 4] for s in "xy")
    assert min(len(x), len(y)) >= 5 and set(x) <= h and set(y) <= g
