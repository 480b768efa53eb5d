"""Quality rules: a table of thresholds compiled into one projection.

Each rule names a metric of the text and the range in which it is accepted. `compiled` turns the table into the list
of the rules that a row breaks; nothing is shuffled and no user function runs, so the work is one pass over the texts
at any size and a hot source is just more rows.

Defined cases: a null text counts as empty; a text without words has ratios of zero and breaks the length rule.
Repeated rows are judged alike. Extra columns pass through `apply_rules` untouched, also when they are named like a
metric. An empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatmeter.llm.common import spare, whole, words

WINDOW = 8

# Frequent function words of the languages expected in the corpus.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "with", "as", "on", "be", "by", "this",
    "de", "la", "le", "les", "des", "et", "en", "un", "une", "que", "du", "est", "pour", "dans", "pas",
    "der", "die", "das", "und", "den", "von", "zu", "ist", "mit", "dem", "nicht", "auf", "sich",
    "el", "los", "las", "y", "se", "del", "por", "con", "no", "su", "una", "es",
)


@dataclass(frozen=True)
class Rule:
    """`metric` must lie in [low, high] for texts of at least `from_words` words; a missing bound is open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


# The two base rules, then the ratio rules. n_repeat_words: words inside repeated 8-word windows.
BASE_RULES = (
    Rule("too_short", "n_words", low=20),
    Rule("repeated_windows", "repeat_percent", high=30),
)
RATIO_RULES = (
    Rule("word_length", "mean_word_chars", low=2.0, high=14.0),
    Rule("symbols", "symbol_ratio", high=0.10),
    Rule("stop_words", "stop_ratio", low=0.02, from_words=50),
    Rule("repeated_lines", "dup_line_ratio", high=0.50),
)


def counted(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    """`docs` with one struct column of counts appended, and the metrics as expressions over it.

    The steps are separate projections because each array is used several times; Spark keeps them apart for the same
    reason. A repeated window is found by sorting (hash, position) pairs, only for texts that have one: the covered
    words are then the lengths of the windows' overlaps, summed in one walk.
    """
    own = list(docs.columns)
    t, w, h, r = (spare(own, n) for n in ("_text", "_words", "_windows", "_repeats"))
    out = spare(own, "_counts")
    hashes = F.transform(
        F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    pairs = F.array_sort(F.transform(F.col(h), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = docs.select(*own, whole(text).alias(t))
    df = df.select(*own, t, words(F.col(t)).alias(w))
    df = df.select(*own, t, w, F.when(F.size(w) > WINDOW, hashes).alias(h))
    repeated = F.size(F.array_distinct(h)) < F.size(h)
    df = df.select(*own, t, w, F.when(repeated, pairs).alias(r))
    df = df.select(*own, t, w, F.sort_array(F.transform(
        F.filter(F.transform(F.col(r), lambda x, i: F.struct(
            x["i"].alias("i"),
            (((i > 0) & (F.get(F.col(r), i - 1)["h"] == x["h"]))
             | F.coalesce(F.get(F.col(r), i + 1)["h"] == x["h"], F.lit(False))).alias("twice"))),
            lambda x: x["twice"]),
        lambda x: x["i"])).alias(r))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(*own, t, w, r, lines.alias(h))
    df = df.select(*own, F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size(h).cast("long").alias("n_lines"),
        (F.size(h) - F.size(F.array_distinct(h))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(
            F.transform(F.col(r), lambda p, k: F.coalesce(
                F.least(F.lit(WINDOW), F.get(F.col(r), k + 1) - p), F.lit(WINDOW))),
            F.lit(0), lambda total, x: total + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
    ).alias(out))
    c = F.col(out)
    share = lambda part, of: F.coalesce(F.try_divide(c[part].cast("double"), c[of].cast("double")), F.lit(0.0))
    metrics = {name: c[name] for name in
               ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")}
    metrics |= {
        "repeat_percent": 100 * share("n_repeat_words", "n_words"),
        "mean_word_chars": share("word_chars", "n_words"),
        "symbol_ratio": share("n_symbols", "n_words"),
        "stop_ratio": share("n_stop_words", "n_words"),
        "dup_line_ratio": share("n_dup_lines", "n_lines"),
    }
    return df, metrics


def broken(rule: Rule, metrics: dict[str, Column]) -> Column:
    value, out = metrics[rule.metric], F.lit(False)
    if rule.low is not None:
        out = out | (value < rule.low)
    if rule.high is not None:
        out = out | (value > rule.high)
    return out & (metrics["n_words"] >= rule.from_words)


def compiled(rules: tuple[Rule, ...], metrics: dict[str, Column]) -> Column:
    """The names of the broken rules, in table order."""
    return F.array_compact(F.array(*[F.when(broken(r, metrics), F.lit(r.name)) for r in rules])) if rules \
        else F.array().cast("array<string>")


def judged(docs: DataFrame, text: str, rules: tuple[Rule, ...]) -> tuple[DataFrame, dict[str, Column], Column]:
    """`docs` with counts and broken rules appended, the metrics, and the broken rules.

    Rows read and rows broken by each rule are observed metrics of the plan. Spark moves no filter below an observation,
    so a filter on the verdict is not rewritten into many copies of the counting steps.
    """
    df, metrics = counted(docs, text)
    bad = spare(df.columns, "_bad")
    df = df.withColumn(bad, compiled(rules, metrics))
    df = df.observe(f"quality_rules_{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"), *[
        F.count_if(F.array_contains(bad, rule.name)).alias(rule.name) for rule in rules])
    return df, metrics, F.col(bad)


def apply_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE_RULES + RATIO_RULES) -> DataFrame:
    """The rows that break no rule, with the columns they came with."""
    df, _, bad = judged(docs, text, rules)
    return df.where(F.size(bad) == 0).select(*docs.columns)


def rule_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the counts, the broken rules, whether a base rule is among them, and the verdict."""
    df, m, ratios = judged(docs.select(*dict.fromkeys([key, text])), text, RATIO_RULES)
    base = broken(BASE_RULES[0], m) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    return df.select(
        key, *[m[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                       "n_lines", "n_stop_words")],
        base.alias("base_failed"), ratios.alias("failed_rules"),
        (~base & (F.size(ratios) == 0)).alias("kept"))
