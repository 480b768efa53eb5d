"""Every operator over texts of extreme forms: a million blanks, a word of two megabytes, one word a million times, a text
of 20 MB, and lines without end."""

import pytest

from seatmeter.llm import brown, langid, mil, mixing, packing, periodic, quality_rules, repeats, simhash
from tests.llm.cases import GOOD, edge_docs

LONG = {
    1: " " * 1_000_000, 2: "a\n" + "\n" * 1_000_000 + "b", 3: "w" * 2_000_000, 4: "word " * 1_000_000,
    5: " ".join(f"{GOOD} {k}" for k in range(120_000)), 6: GOOD, 7: "\t" * 500_000 + GOOD, 8: "é" * 700_000, 9: ""}


@pytest.fixture(scope="module")
def docs(spark):
    return edge_docs(spark, [(i, t, "en" if i < 8 else "fr", "ab"[i % 2]) for i, t in LONG.items()]).repartition(3).cache()


def by_id(df, column):
    return {r["doc_id"]: r[column] for r in df.collect()}


def test_rules(docs):
    words = by_id(quality_rules.rule_report(docs), "n_words")
    assert words == {i: len(t.split()) for i, t in LONG.items()}


def test_packing(docs):
    packed = packing.pack(packing.pieces(docs, with_ids=False)).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in packed} == {i: len(packing.token_ids(t)) for i, t in LONG.items()}


def test_classifier(spark, docs):
    labels = spark.createDataFrame([(i, int(i in (5, 6, 7))) for i in LONG], "doc_id long, quality int")
    scores = by_id(mil.quality_report(docs, labels), "score")
    assert set(scores) == set(LONG) and all(0 <= s <= 1 for s in scores.values())


def test_lm_scores(docs):
    rows = {r.doc_id: r for r in brown.lm_scores(docs, clustered=8, classes=3).collect()}
    assert {i: r.n_tokens for i, r in rows.items()} == {i: len(t.split()) + 1 for i, t in LONG.items()}
    assert all(r.score <= 0 for r in rows.values())


def test_near_duplicates(docs):
    found = by_id(simhash.near_duplicates(docs), "component_id")
    assert found[1] == found[9] == 1 and found[6] == found[7] == 6


def test_mixing(docs):
    rows = mixing.mixing_report(docs).collect()
    assert {r.doc_id for r in rows} == set(LONG)


def test_language(docs):
    found = by_id(langid.language_report(docs), "lang_pred")
    assert found[5] == found[6] == "en" and found[1] == found[9] == "und"


def test_periodic_runs(docs):
    rows = {r.doc_id: r for r in periodic.periodic_runs(docs).collect()}
    assert [tuple(r) for r in rows[4].runs] == [(0, 1_000_000, 1)] and rows[4].collapsed == "word"
    assert rows[3].n_words == 1 and rows[5].n_words == len(LONG[5].split())


def test_repeats(docs):
    rows = {r.doc_id: r for r in repeats.repeats_removed(docs).collect()}
    assert [tuple(s) for s in rows[1].spans] == [(0, 1_000_000)] and bytes(rows[8].kept) == b"" and bytes(rows[6].kept) == GOOD.encode()
    assert [tuple(s) for s in rows[2].spans] == [(1, 1_000_002)]
    assert len(bytes(rows[5].kept)) == len(LONG[5].encode())
