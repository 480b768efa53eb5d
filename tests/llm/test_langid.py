import numpy as np

from seatmeter.llm import langid as q
from tests.llm.cases import edge_docs

BIG = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    rows = q.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and len(held) > 200
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.98


def test_held_out_languages_do_not_matter(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").limit(300)
    other = docs.withColumn("lang", q.F.when(q.remainder("doc_id", 4) == 2, "xx").otherwise(docs.lang))
    a, b = (sorted(map(tuple, q.language_report(d).collect())) for d in (docs, other))
    assert a == b


def test_mixture_of_two_languages(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    model = q.learned(docs)
    by = {g: [t.text for t in docs.where((docs.lang == g) & (docs.n_chars > 1500)).limit(4).collect()] for g in ("en", "de", "fr")}
    mixed = spark.createDataFrame([(by["en"][0] + " " + by["de"][0][:700],), (by["fr"][1],)], "text string")
    first, second = (r.language for r in q.identified(mixed, model).collect())
    assert first.languages == ["en", "de"] and 0.5 < first.score < 1 and abs(sum(first.shares) - 1) < 1e-9
    assert second.languages == ["fr"] and second.score == 1


def test_proportions_match_plain_expectation_maximisation():
    rng = np.random.default_rng(2)
    model = q.Model(["a", "b"], np.log(rng.dirichlet([1] * q.BINS, 2).T + 1e-9).astype(np.float32))
    words = [bytes(rng.integers(97, 123, 4).astype(np.uint8)) for _ in range(30)]
    logs = model.word_logs(words).astype(float)
    lik = np.exp(logs - logs.max(axis=1, keepdims=True))
    pi = np.array([0.5, 0.5])
    for _ in range(q.STEPS):
        r = lik * pi
        pi = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
    value = np.log(lik @ pi).sum()
    single = [np.log(np.maximum(lik[:, k], 1e-300)).sum() for k in range(2)]
    got = q.proportions(model, [words, words[:1]])
    if 2 * (value - single[int(pi.argmax())]) <= np.log(30):
        assert got[0].max() == 1
    else:
        assert np.allclose(got[0], pi)
    # Each word by itself, summed trigram by trigram.
    grams, starts = q._trigrams(words)
    assert len(grams) == sum(map(len, words)) and np.allclose(logs[0], model.table[grams[:4]].sum(axis=0))


def test_edges(spark):
    docs = edge_docs(spark)
    report = {r.doc_id: r for r in q.language_report(docs).collect()}
    for i in (3, 4, 5, 14):
        assert report[i].lang_pred == "und" and report[i].score == 0 and report[i].n_languages == 0
    assert report[1].lang_pred == "en" and report[9].lang_pred in ("en", "fr")
    assert q.language_report(edge_docs(spark, [])).count() == 0
    model = q.learned(docs)
    assert q.identified(docs, model, into="found").columns == [*docs.columns, "found"]


def test_nothing_to_learn_from(spark):
    docs = edge_docs(spark, [(1, "some words", None, "a"), (2, None, "en", "a")])
    assert [r.lang_pred for r in q.language_report(docs).collect()] == ["und", "und"]


def test_many_languages_pass_through_tasks(spark, monkeypatch):
    monkeypatch.setattr(q, "HISTOGRAMS", 2)
    docs = edge_docs(spark, [(i, "abc def " * 3 + "qxz"[i % 3] * 6, f"l{i % 5}", "a") for i in range(50)])
    assert q.learned(docs).languages == [f"l{k}" for k in range(5)]


def test_rounds_end_at_a_tolerance_and_words_count_as_often_as_they_occur():
    """Three documents that need very different numbers of rounds, together as alone, and as by the definition."""
    rng = np.random.default_rng(4)
    model = q.Model(["a", "b", "c"], np.log(rng.dirichlet([0.3] * q.BINS, 3).T + 1e-7).astype(np.float32))
    words = [bytes(rng.integers(97, 123, 5).astype(np.uint8)) for _ in range(40)]
    documents = [words * 3 + words[:7] * 2, words[5:9], words[:25]]
    together = q.proportions(model, documents)
    for got, document in zip(together, documents):
        assert np.allclose(got, q.proportions(model, [q.Counter(document)])[0])
        logs = model.word_logs(document).astype(float)
        lik = np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -60.0))
        pi = (got > 0) / (got > 0).sum()
        for _ in range(5000):
            r = lik * pi
            pi = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
        assert np.allclose(got, pi, atol=1e-4)


def test_long_texts_are_read_in_parts(spark, monkeypatch):
    text = "The house of the north is by the water " * 40_000 + "x" * 1_200_000 + " \n" * 500_000
    assert "".join(q._parts(text)) == text and max(map(len, q._parts(text))) < 2_300_000
    monkeypatch.setattr(q, "PART", 50)
    cut = [w for part in q._parts(text[:5000]) for w in q._words(part)]
    assert cut == q._words(text[:5000])
    docs = edge_docs(spark, [(k, t, g, "a") for k, (t, g) in enumerate(
        [("the house of the north", "en"), ("das haus am see im winter", "de")] * 4)] + [(99, text, None, "a")])
    assert {r.doc_id: r.lang_pred for r in q.language_report(docs).collect()}[99] == "en"
