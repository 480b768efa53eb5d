import pytest

from seatmeter.llm import quality_rules as q
from tests.llm.cases import GOOD, SF, edge_docs, words


def brute(text):
    w, t = words(text), text or ""
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    seen, covered = {}, set()
    for g in windows:
        seen[g] = seen.get(g, 0) + 1
    for i, g in enumerate(windows):
        if seen[g] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in t.split("\n") if words(x)]
    repeat = len(covered)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat,
            len(w) < 20 or 100 * repeat > 30 * len(w))


@pytest.mark.parametrize("source", ["edges", "table"])
def test_base_figures_match_brute_force(spark, source):
    docs = edge_docs(spark) if source == "edges" else spark.read.parquet(f"{SF}/documents.parquet")
    texts = sorted((r["text"] or "" for r in docs.collect()))
    rows = q.rule_report(docs.withColumn("doc_id", docs["text"])).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.doc_id)
        assert r.kept is (not r.base_failed and not r.failed_rules)


def test_verdicts(spark):
    report = {r.doc_id: r for r in q.rule_report(edge_docs(spark)).collect()}
    assert report[1].kept and report[2].kept and report[13].kept
    assert report[12].failed_rules == ["word_length", "symbols", "stop_words", "repeated_lines"][1:3]
    assert not any(report[i].kept for i in (3, 4, 5, 6, 9, 10, 11, 12))


def test_filter_keeps_columns_and_repeated_rows(spark):
    docs = edge_docs(spark)
    kept = q.apply_rules(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 2, 13]
    assert q.apply_rules(edge_docs(spark, [])).count() == 0


def test_filters_stay_above_the_counting(spark):
    for df in (q.apply_rules(edge_docs(spark)), q.rule_report(edge_docs(spark)).where("kept and n_words > 3")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Filter") < plan.index("CollectMetrics") and plan.count("split(") == 2


def test_own_rule_table(spark):
    rules = (q.Rule("long", "n_words", high=5),)
    kept = q.apply_rules(edge_docs(spark, [(1, GOOD, "en", "a"), (2, "a b", "en", "a")]), rules=rules)
    assert [r.doc_id for r in kept.collect()] == [2]


def test_no_python_in_the_plan(spark):
    plan = q.rule_report(edge_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
