import math

import pytest
from pyspark.sql import functions as F

from seatmeter.llm import mixing as q
from tests.llm.cases import edge_docs, words


def shares_of(rows):
    tokens = {}
    for source, text in rows:
        tokens[source] = tokens.get(source, 0) + len(words(text))
    return tokens


def brute_exponent(shares, targets):
    """Plain bisection over the same conditions."""
    def figures(a):
        z = sum(s ** a for s in shares)
        p = [s ** a / z for s in shares]
        budget = targets.budget if targets.budget is not None else max(shares) ** (1 - a) * z
        return -sum(x * math.log(x) for x in p), max(budget * x / s for x, s in zip(p, shares))

    def bisected(ok, good):
        if ok(1.0 if good == 1 else 0.0) is False:
            return 0.0 if good == 0 else 1.0
        low, high = 0.0, 1.0
        for _ in range(60):
            middle = (low + high) / 2
            if ok(middle) == (good == 0):
                low = middle
            else:
                high = middle
        return low if good == 0 else high

    a = 1.0
    if targets.entropy is not None:
        wanted = targets.entropy * math.log(len(shares))
        a = 1.0 if figures(1.0)[0] >= wanted else bisected(lambda x: figures(x)[0] >= wanted, 0)
    elif targets.epochs is not None:
        a = 0.0
    if targets.epochs is not None and figures(0.0)[1] > targets.epochs:
        a = max(a, bisected(lambda x: figures(x)[1] <= targets.epochs, 1))
    return a


DOCS = [(i, "word " * (5 + i % 7), "en", "hot") for i in range(300)] + \
       [(1000 + i, "word " * (3 + i % 5), "en", f"s{i % 4}") for i in range(120)] + \
       [(2000 + i, "a b c", "en", None) for i in range(20)]


@pytest.mark.parametrize("targets", [
    q.Targets(), q.Targets(entropy=0.8, epochs=None), q.Targets(entropy=None, epochs=1.5),
    q.Targets(entropy=0.99, epochs=3.0), q.Targets(budget=700.0, epochs=None), q.Targets(entropy=0.9, budget=5000.0)])
def test_plan_and_copies_match_brute_force(spark, targets):
    docs = edge_docs(spark, DOCS)
    tokens = shares_of((s, t) for _, t, _, s in DOCS)
    total = sum(tokens.values())
    relative = q.Targets(targets.entropy, targets.epochs, targets.budget and targets.budget / total)
    a = brute_exponent([n / total for n in tokens.values()], relative)
    z = sum((n / total) ** a for n in tokens.values())
    budget = targets.budget or total * (max(tokens.values()) / total) ** (1 - a) * z
    wanted = {s: budget * (n / total) ** a / z for s, n in tokens.items()}

    rows = q.mixing_report(docs, targets).collect()
    size = {i: len(words(t)) for i, t, _, _ in DOCS}
    got = dict.fromkeys(tokens, 0)
    for r in rows:
        got[r.source] += size[r.doc_id]
    for s in tokens:
        # The last epoch ends before the row that would exceed the budget: nothing over it, less than a row below it.
        assert wanted[s] - 13 < got[s] <= wanted[s] + 1e-3 * wanted[s]
    times = {}
    for r in rows:
        times.setdefault((r.source, r.doc_id), []).append(r.epoch)
    for s in tokens:
        per_row = [times.get((s, i), []) for i, _, _, source in DOCS if source == s]
        assert max(map(len, per_row)) - min(map(len, per_row)) <= 1
        assert all(sorted(e) == list(range(len(e))) for e in per_row)
    assert all(0 <= r.block < targets.blocks for r in rows)


def test_every_row_is_read_without_a_budget(spark):
    docs = edge_docs(spark, DOCS)
    assert q.mixed(docs).select("doc_id").distinct().count() == len(DOCS)
    assert max(r[1] for r in q.mixed(docs).groupBy("doc_id").count().collect()) <= 2


def test_last_epoch_is_a_prefix_of_its_permutation(spark):
    docs = edge_docs(spark, [(i, "w " * (1 + i % 3), "en", "a") for i in range(200)])
    rows = docs.select(F.col("source"), q._row_hash("doc_id", "text").alias("row"), F.lit(0).alias("number"),
                       F.size(q.words(F.col("text"))).cast("long").alias("tokens"), "doc_id")
    order = sorted(rows.select("doc_id", "tokens", q._turn(F.col("row"), F.lit(0)).alias("turn")).collect(),
                   key=lambda r: r.turn)
    taken, total = [], 0
    for r in order:
        total += r.tokens
        if total > 101.5:
            break
        taken.append(r.doc_id)
    got = q.mixing_report(docs, q.Targets(entropy=None, epochs=None, budget=101.5)).collect()
    assert sorted(r.doc_id for r in got) == sorted(taken)


def test_edges(spark):
    docs = edge_docs(spark)
    kept = q.mixed(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {r.doc_id for r in docs.collect()} == set(ids)
    assert q.mixed(edge_docs(spark, [])).count() == 0
    no_tokens = edge_docs(spark, [(1, "", "en", "a"), (2, None, "en", None)])
    assert sorted(r.doc_id for r in q.mixed(no_tokens).collect()) == [1, 2]


def test_blocks_hold_the_weights(spark):
    docs = edge_docs(spark, [(i, "w w w", "en", "a" if i % 4 else "b") for i in range(4000)])
    rows = q.mixing_report(docs, q.Targets(entropy=0.9, epochs=4.0, blocks=8)).groupBy("block", "source").count().collect()
    per = {(r.block, r.source): r["count"] for r in rows}
    shares = [per[b, "a"] / (per[b, "a"] + per[b, "b"]) for b in range(8)]
    assert max(shares) - min(shares) < 0.12


@pytest.mark.parametrize("budget", [1300.0, 1800.0, 400.0, 2401.0])
def test_equal_rows_are_cut_at_the_budget(spark, budget):
    """Half the rows are copies of one: the budget is met to within a row, and other rows are read as often as before."""
    rows = [(5, "a b c d", "en", "a")] * 300 + [(100 + i, f"w{i} x y z", "en", "a") for i in range(300)]
    got = q.mixing_report(edge_docs(spark, rows), q.Targets(entropy=None, epochs=None, budget=budget)).collect()
    assert budget - 4 < 4 * len(got) <= budget
    times = {}
    for r in got:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert all(times.get(100 + i, 0) in (int(budget // 2400), int(budget // 2400) + 1) for i in range(300))


def test_written_rows_stand_by_block_and_place(spark, tmp_path):
    docs = edge_docs(spark, DOCS)
    q.mixed(docs).write.parquet(str(tmp_path / "m"))
    want = {}
    for r in q.mixing_report(docs).collect():
        want.setdefault(r.doc_id, []).append((r.block, r.place))
    held, last = 0, (-1, 0)
    for path in sorted((tmp_path / "m").glob("*.parquet")):
        for r in spark.read.parquet(str(path)).collect():
            later = sorted(x for x in want[r.doc_id] if x >= last)
            last = later[0]
            want[r.doc_id].remove(last)
            held += 1
    assert not any(want.values()) and held >= len(DOCS)
