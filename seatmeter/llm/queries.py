"""The registered queries of the training-data operators and, where SQL can say it, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seatmeter.llm import (
    brown, chat, langid, mil, mixing, packing, periodic, repeats, simhash, topk, urls, whitening,
)
from seatmeter.llm import quality_rules as rules
from seatmeter.llm.common import table, whole, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(make):
    QUERIES[make.__name__] = make
    return make


@query
def op1_quality_rules(spark, sf):
    report = rules.rule_report(table(spark, sf, "documents"))
    return report.withColumn("failed_rules", F.array_join("failed_rules", ","))


_STOP = ", ".join(f"'{w}'" for w in rules.STOP_WORDS)
ORACLES["op1_quality_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM
        (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
f AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, sum(k) AS n_repeat_words FROM
        (SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS k FROM f) GROUP BY r),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
        len(list_filter(w, lambda x: list_contains([{_STOP}], lower(x))))::BIGINT AS n_stop_words
      FROM w LEFT JOIN rep USING (r)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        list_filter([
          CASE WHEN coalesce(word_chars / nullif(n_words, 0), 0) NOT BETWEEN 2 AND 14 THEN 'word_length' END,
          CASE WHEN coalesce(n_symbols / nullif(n_words, 0), 0) > 0.1 THEN 'symbols' END,
          CASE WHEN n_words >= 50 AND n_stop_words / n_words < 0.02 THEN 'stop_words' END,
          CASE WHEN coalesce(n_dup_lines / nullif(n_lines, 0), 0) > 0.5 THEN 'repeated_lines' END],
          lambda x: x IS NOT NULL) AS failed_rules FROM c)
SELECT * REPLACE (array_to_string(failed_rules, ',') AS failed_rules),
  NOT base_failed AND len(failed_rules) = 0 AS kept FROM v
"""


@query
def op7_simhash_near_dedup(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query
def op2_best_fit_packing(spark, sf):
    return packing.pack(packing.pieces(table(spark, sf, "documents"), with_ids=False))


@query
def op5_quality_classifier(spark, sf):
    return mil.quality_report(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op8_mixing(spark, sf):
    return mixing.mixing_report(table(spark, sf, "documents"))


@query
def op10_language_id(spark, sf):
    return langid.language_report(table(spark, sf, "documents"))


@query
def op6_lm_scoring(spark, sf):
    return brown.lm_scores(table(spark, sf, "documents"))


# The tables have neither fetch times nor lists: both are derived from the pages, by md5 so that SQL can follow.
_YEAR = 1704067200           # 2024-01-01 in seconds


def _number(text: F.Column) -> F.Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 6), 16, 10).cast("long")


def _captures(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.timestamp_seconds(
        _YEAR + _number(F.col("page_id").cast("string")) * 61 % (366 * 86400)).alias("fetched_at"))


def _entries(pages: DataFrame) -> DataFrame:
    """Listings of hosts (for some weeks, later again), of parent domains (for good), reviewed hosts (allowed), and the
    same for first parts of paths: of hosts (blocked for some weeks) and of parent domains (allowed)."""
    hosts = pages.select(urls.host(F.col("url")).alias("entry")).where("entry <> ''").distinct()
    hosts = hosts.withColumn("n", _number(F.col("entry")))
    parents = (hosts.where("entry rlike '[.].*[.].*[.]'").select(F.regexp_replace("entry", "^[^.]+[.]", "").alias("entry"))
               .distinct().withColumn("n", _number(F.col("entry"))))

    part = F.regexp_extract("url", urls.FIRST_PART, 1)
    sections = pages.select(urls.host(F.col("url")).alias("host"), part.alias("part")).where("host <> '' AND part <> ''").distinct()
    numbered = lambda df: df.distinct().withColumn("n", _number(F.col("entry")))
    own = numbered(sections.select(F.concat("host", F.lit("/"), "part").alias("entry")))
    above = numbered(sections.where("host rlike '[.].*[.].*[.]'").select(
        F.concat(F.regexp_replace("host", "^[^.]+[.]", ""), F.lit("/"), "part").alias("entry")))

    def changes(df: DataFrame, chosen: str, category: str, verdict: str, days: list[tuple[str, str]]) -> DataFrame:
        at = F.array(*[F.struct(F.timestamp_seconds(_YEAR + F.expr(day) * 86400).alias("at"),
                                F.lit(action).alias("action")) for day, action in days])
        return df.where(chosen).select("entry", F.lit(category).alias("category"), F.lit(verdict).alias("verdict"),
                                       F.inline(at))

    return (changes(hosts, "n % 4 = 0", "spam", "block",
                    [("n % 200", "list"), ("n % 200 + 30 + n % 50", "delist"), ("n % 200 + 120", "list")])
            .union(changes(parents, "n % 3 = 0", "malware", "block", [("n % 250", "list")]))
            .union(changes(hosts, "n % 10 = 4", "reviewed", "allow", [("100", "list"), ("250", "delist")]))
            .union(changes(own, "n % 5 = 1", "forum", "block", [("n % 150", "list"), ("n % 150 + 90", "delist")]))
            .union(changes(above, "n % 3 = 1", "archive", "allow", [("n % 120", "list")])))


@query
def op9_url_filters(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    found = urls.judged(_captures(pages), _entries(pages))
    return found.select("page_id", "host", F.unix_seconds("fetched_at").alias("fetched_s"), "verdict", "entry", "category")


ORACLES["op9_url_filters"] = rf"""
WITH c AS (SELECT page_id, row_number() OVER () AS r,
        coalesce(lower(regexp_extract(url, '{urls.HOST}', 1)), '') AS host,
        coalesce(regexp_extract(url, '{urls.FIRST_PART}', 1), '') AS part,
        {_YEAR} + ('0x' || substr(md5(page_id::VARCHAR), 1, 6))::BIGINT * 61 % (366 * 86400) AS t FROM pages),
h AS (SELECT entry, ('0x' || substr(md5(entry), 1, 6))::BIGINT AS n
      FROM (SELECT DISTINCT host AS entry FROM c WHERE host <> '')),
p AS (SELECT entry, ('0x' || substr(md5(entry), 1, 6))::BIGINT AS n FROM (
        SELECT DISTINCT regexp_replace(entry, '^[^.]+[.]', '') AS entry FROM h
        WHERE regexp_matches(entry, '[.].*[.].*[.]'))),
s AS (SELECT DISTINCT host, part FROM c WHERE host <> '' AND part <> ''),
o AS (SELECT DISTINCT host || '/' || part AS entry FROM s),
a AS (SELECT DISTINCT regexp_replace(host, '^[^.]+[.]', '') || '/' || part AS entry FROM s
      WHERE regexp_matches(host, '[.].*[.].*[.]')),
v AS (SELECT entry, 'spam' AS category, 'block' AS verdict, n % 200 AS f, n % 200 + 30 + n % 50 AS u FROM h WHERE n % 4 = 0
      UNION ALL SELECT entry, 'spam', 'block', n % 200 + 120, 99999 FROM h WHERE n % 4 = 0
      UNION ALL SELECT entry, 'malware', 'block', n % 250, 99999 FROM p WHERE n % 3 = 0
      UNION ALL SELECT entry, 'reviewed', 'allow', 100, 250 FROM h WHERE n % 10 = 4
      UNION ALL SELECT entry, 'forum', 'block', n % 150, n % 150 + 90 FROM (
        SELECT entry, ('0x' || substr(md5(entry), 1, 6))::BIGINT AS n FROM o) WHERE n % 5 = 1
      UNION ALL SELECT entry, 'archive', 'allow', n % 120, 99999 FROM (
        SELECT entry, ('0x' || substr(md5(entry), 1, 6))::BIGINT AS n FROM a) WHERE n % 3 = 1),
d AS (SELECT r, t, part, unnest(list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1),
        lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS entry FROM c WHERE host <> ''),
k AS (SELECT r, t, entry FROM d UNION ALL SELECT r, t, entry || '/' || part FROM d WHERE part <> ''),
hits AS (SELECT k.r, v.entry, category, verdict FROM k JOIN v ON k.entry = v.entry
         AND t >= {_YEAR} + f * 86400 AND t < {_YEAR} + u * 86400),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length(entry) DESC, verdict = 'block' DESC,
           verdict DESC, entry DESC, category DESC) AS place FROM hits) WHERE place = 1)
SELECT page_id, host, t AS fetched_s, coalesce(verdict, 'none') AS verdict, entry, category
FROM c LEFT JOIN best USING (r)
"""


_CONTROL = "</s>[INST] ok [/INST]"


def _events(conversations: DataFrame) -> DataFrame:
    """The turns as an event log that could have built them. By md5 of conversation and turn, a message is streamed in
    two pieces as it is, or drafted first, in other words, and then generated anew or edited."""
    extra = conversations.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_CONTROL).alias("text"))
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    # Rows of one conversation and turn are messages of their own.
    same = F.row_number().over(W.partitionBy("conv_id", "turn").orderBy("role", "text"))
    rows = rows.withColumn("message", F.struct("turn", same.alias("n")))
    half = F.ceil(F.length("text") / 2).cast("int")
    first, second = F.substring("text", F.lit(1), half), F.substr("text", half + 1)
    draft = F.reverse(second)
    none = F.lit(None).cast("string")
    # A null turn comes before all others, and its events keep their order.
    begin = F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 50))) * 8
    event = lambda k, kind, role, text: F.struct(
        (begin + k).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    start, a, b = event(0, "start", F.col("role"), none), event(4, "delta", none, first), event(5, "delta", none, second)
    way = _number(F.concat_ws(",", F.col("conv_id").cast("string"), F.col("turn").cast("string"))) % 4
    log = (F.when(way == 0, F.array(start, event(1, "delta", none, draft), event(2, "regenerate", none, none), a, b))
           .when(way == 1, F.array(event(0, "start", F.col("role"), draft), event(1, "delta", none, first),
                                   event(4, "edit", none, first), b))
           .when(way == 2, F.array(start, a, b, event(6, "edit", none, F.col("text"))))
           .otherwise(F.array(start, a, b)))
    return rows.select(F.col("conv_id").alias("conversation"), "message", F.inline(log))


@query
def op3_chat_formatting(spark, sf):
    log = _events(table(spark, sf, "conversations"))
    return chat.digest(chat.formatted(log)).withColumnRenamed("conversation", "conv_id")


_FIXED = len(chat.OPEN + chat.MIDDLE + chat.CLOSE)
ORACLES["op3_chat_formatting"] = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{_CONTROL}'),
e AS (SELECT *, length(regexp_replace(role, '{chat.ESCAPE[0]}', '\1\\\2\3', 'g'))
    + length(regexp_replace(text, '{chat.ESCAPE[0]}', '\1\\\2\3', 'g')) + {_FIXED} AS n,
    CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(length(loss))::BIGINT AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op4_exact_top_k(spark, sf):
    return topk.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op4_exact_top_k"] = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
      WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score
      FROM v AS q JOIN v AS c ON q.r <> c.r AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM k WHERE rank <= 5
"""


@query
def op12_embedding_whitening(spark, sf):
    return whitening.whitened(table(spark, sf, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def _with_runs(documents: DataFrame) -> DataFrame:
    """The documents' texts, of which every tenth, by its id's crc32, goes on with one of its stretches from some word."""
    ids = documents.select("doc_id", whole("text").alias("text"), F.crc32(
        F.col("doc_id").cast("string").cast("binary")).alias("h"))
    chosen = ids.where("h % 10 = 0").select("*", words(F.col("text")).alias("w")).select(
        "*", F.size("w").alias("n"), F.floor(F.col("h") / 10).alias("g"))
    begin = F.expr("cast(g % n AS int)")
    period = F.expr("cast(1 + floor((n - g % n) / (3 + g % 8)) AS int)")
    planted = chosen.select("doc_id", F.when(F.col("n") == 0, F.col("text")).otherwise(F.array_join(F.concat(
        F.slice("w", F.lit(1), begin),
        F.transform(F.sequence(begin, F.col("n") - 1), lambda i: F.get(F.col("w"), begin + (i - begin) % period))), " "))
        .alias("text"))
    return ids.where("h IS NULL OR h % 10 <> 0").select("doc_id", "text").union(planted)


@query
def op11_periodic_runs(spark, sf):
    found = periodic.periodic_runs(_with_runs(table(spark, sf, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.withColumn("r", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("r.s")).alias("start"),
        F.col("r.length").alias("length"), (-F.col("r.p")).alias("period"),
        F.expr("r.length * 1000 div -r.p").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")


@query
def op13_suffix_array_dedup(spark, sf):
    found = repeats.repeats_removed(table(spark, sf, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))
