"""URL filters by a temporal list join: every capture is judged by the list entries in force when it was fetched.

Dated entries (an entry is listed or taken off, with a category and a verdict, block or allow) become intervals of
validity. An entry names a domain (`example.com`, which covers its subdomains) or a domain with the first part of the
path (`example.com/forum`). A capture asks for its host, every parent domain, and each of these with the first path
part; of the entries in force the longest one decides, and `block` wins among equally long ones.

The as-of join is an equality join on entry and calendar month: an interval is cut into the months that captures lie in,
so a capture meets the intervals of one month of one entry, not an entry's whole history. A host with a third of all
captures makes no group: captures are joined, not gathered, and only captures with a hit are aggregated afterwards, by
row. Nothing is broadcast beyond what Spark finds small enough by itself.

Defined cases: a null or unparsable url, or a null fetch time, has verdict `none`. Entries with a null in entry, time or
action are passed over. An entry listed twice in a row stays listed; of changes at the same time, `list` comes last. An
interval includes its start and not its end. Repeated captures are each judged. Extra columns of the captures pass
through `judged`; null keys are allowed. Without entries every verdict is `none`; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seatmeter.llm.common import settled, spare

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
FIRST_PART = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"


def host(url: Column) -> Column:
    """Lower-cased host of an absolute url, empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def asked(url: Column) -> Column:
    """The entries a url can match: its host and parent domains (two labels at least), also with the first path part."""
    labels = F.split(host(url), r"\.")
    part = F.coalesce(F.regexp_extract(url, FIRST_PART, 1), F.lit(""))
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
                          lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    with_part = F.when(part != "", F.transform(domains, lambda d: F.concat(d, F.lit("/"), part))).otherwise(
        F.array().cast("array<string>"))
    return F.when(host(url) != "", F.array_distinct(F.concat(domains, with_part))).otherwise(
        F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(entry, category, verdict, since, until): until is null while an entry is still listed.

    `entries` has entry, category, verdict, at (timestamp) and action (list or delist).
    """
    # Hosts ignore case, paths do not.
    domain = F.substring_index("entry", "/", 1)
    entry = F.concat(F.lower(domain), F.substr("entry", F.length(domain) + 1))
    of = W.partitionBy("entry", "category", "verdict").orderBy("at", F.desc(F.col("action") == "delist"))
    changes = (entries.select(entry.alias("entry"), "category", "verdict", "at", "action")
               .where("entry is not null and at is not null and action in ('list', 'delist')").distinct()
               .withColumn("before", F.lag("action").over(of))
               .where("action <> coalesce(before, 'delist')"))
    return (changes.withColumn("until", F.lead("at").over(of)).where("action = 'list'")
            .select("entry", "category", "verdict", F.col("at").alias("since"), "until")
            .where("until is null or until > since"))


def judged(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """`captures` with host, verdict (block, allow or none), entry and category of the entry that decides."""
    own = list(captures.columns)
    row = spare(own, "_row")
    marked = settled(captures.withColumn(row, F.monotonically_increasing_id()), "url-captures")
    slim = marked.select(F.col(row).alias("row"), F.col(fetched).alias("t"), F.explode(asked(F.col(url))).alias("entry")) \
        .where("t is not null").withColumn("month", F.trunc(F.col("t"), "month"))
    first, last = marked.agg(F.min(fetched), F.max(fetched)).first()
    valid = intervals(entries)
    if first is None:
        valid = valid.where(F.lit(False))
    start = F.greatest(F.col("since"), F.lit(first).cast("timestamp"))
    stop = F.least(F.coalesce("until", F.lit(last).cast("timestamp")), F.lit(last).cast("timestamp"))
    by_month = (valid.where(start <= stop)
                .withColumn("month", F.explode(F.sequence(
                    F.trunc(start, "month"), F.trunc(stop, "month"), F.expr("interval 1 month")))))
    hits = slim.join(by_month, ["entry", "month"]).where("since <= t and (until is null or t < until)")
    decided = hits.groupBy("row").agg(F.max(F.struct(
        F.length("entry").alias("size"), (F.col("verdict") == "block").alias("first"), "verdict", "entry", "category",
    )).alias("hit"))
    hit = spare([*own, row], "_hit")
    decided = decided.select(F.col("row").alias(row), F.col("hit").alias(hit))
    return marked.join(decided, row, "left").select(
        *own, host(F.col(url)).alias("host"), F.coalesce(F.col(hit)["verdict"], F.lit("none")).alias("verdict"),
        F.col(hit)["entry"].alias("entry"), F.col(hit)["category"].alias("category"))


def blocked_removed(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """The captures that no entry blocked when they were fetched, with the columns they came with."""
    inner = [f"_{k}" for k in range(len(captures.columns))]      # apart from host, verdict, entry and category
    named = dict(zip(captures.columns, inner))
    verdict = judged(captures.toDF(*inner), entries, named[url], named[fetched])
    return verdict.where("verdict <> 'block'").select(*inner).toDF(*captures.columns)
