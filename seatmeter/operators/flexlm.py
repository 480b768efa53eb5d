"""Server status, license pools and checkouts from FlexLM status texts.

Lines are classified by regular expressions in a fixed test order; what a line means also depends on the
lines above it (current feature, its license version, a removal of the feature just named), which window
functions over the text carry along. Lines without a meaning are dropped where the text is read. One shuffle by text
serves all later steps, and it moves the fields taken from the other lines (of stored texts; rendered test texts are
already dealt out by text, so nothing is left to move).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatmeter.functions.dates import clock_time, expiry_timestamp, flexlm_clock
from seatmeter.operators.dump_lines import (
    CHECKOUT_COLUMNS, FEATURE_COLUMNS, STATUS_COLUMNS, carried, first_kind, in_order, lowered, numbered_lines,
    parts, stripped,
)

# Line patterns, and the license count of an uncounted feature.
SERVER_UP = r"([^\s]+):\s+license server UP.*v(\d+\.\d+\.\d+)"
CANNOT_CONNECT = r"Cannot connect to license server"
CANNOT_READ = r"Cannot read data"
ERROR_STATUS = r"Error getting status"
VENDOR_DOWN = r"vendor daemon is down"
USAGE = r"(?i)users of\s+(.+?):\s+\(Total of (\d+) license[s]? issued;\s+Total of (\d+) license[s]? in use\)"
NO_SUCH_FEATURE = r"(?i)no such feature exists"
UNCOUNTED = r"(?i)users of\s+(.+?):\s+\(uncounted, node-locked\)"
POOL_PERMANENT = r"(?i)(\w+)\s+(\d+|\d+\.\d+)\s+(\d+)\s+(\w+)\s+(permanent)"
POOL_VENDOR_DATE = r"(?i)(\w+)\s+(\d+|\d+\.\d+)\s+(\d+)\s+(\w+)\s+(\d+-\w+-\d+)$"
POOL_DATE_VENDOR = r"(?i)(\w+)\s+(\d+|\d+\.\d+)\s+(\d+)\s+(\d+-\w+-\d+)(?:\s+(\w+))?$"
CHECKOUT = r"\s+(.+?)\s+(.+?)\s+(.+?)\s+\(v?([^\)]+)\).*start\s+(\w+\s+\d+/\d+(?:/\d+)?\s+\d+:\d+)"
INLINE_VERSION = r'^\s+"([^"]+)"\s+v?([0-9.]+)'
UNCOUNTED_LICENSES = 9999

# Lines that end the reading of a text: resulting service state and message.
FATAL = {
    "cannot_connect": (CANNOT_CONNECT, "down", "Cannot connect to "),
    "cannot_read": (CANNOT_READ, "down", "Cannot read data from "),
    "error_status": (ERROR_STATUS, "down", "Error getting status from "),
    "vendor_down": (VENDOR_DOWN, "warning", "Vendor daemon is down on "),
}
POOL_KINDS = {"pool_permanent": POOL_PERMANENT, "pool_vendor_date": POOL_VENDOR_DATE,
              "pool_date_vendor": POOL_DATE_VENDOR}


# Text that a line has wherever the pattern matches, and a simpler pattern that holds there. Tried first, they spare most
# lines a pattern that backtracks for long where it does not match, the checkout pattern above all.
QUICK_TEXT = {
    SERVER_UP: "license server UP", USAGE: ";", UNCOUNTED: "-", CHECKOUT: "start", POOL_VENDOR_DATE: "-",
    POOL_DATE_VENDOR: "-",
}
QUICK_TEST = {
    USAGE: r"(?i)issued;", UNCOUNTED: r"(?i)uncounted, node-locked",
    CHECKOUT: r"start\s+\w+\s+\d", POOL_PERMANENT: r"(?i)\d\s+\w+\s+permanent",
    POOL_VENDOR_DATE: r"\d-\w+-\d+$", POOL_DATE_VENDOR: r"\d-\w+-\d", INLINE_VERSION: r'^\s+"',
}


def _matches(pattern: str) -> Column:
    test = F.col("line").rlike(pattern)
    if pattern in QUICK_TEST:
        test = F.col("line").rlike(QUICK_TEST[pattern]) & test
    if pattern in QUICK_TEXT:
        test = F.contains("line", F.lit(QUICK_TEXT[pattern])) & test
    return test


def _classified(dumps: DataFrame) -> DataFrame:
    tests = [
        ("up", _matches(SERVER_UP)),
        *[(name, F.contains("line", F.lit(pattern))) for name, (pattern, _, _) in FATAL.items()],
        ("usage", _matches(USAGE)),
        ("uncounted", _matches(UNCOUNTED)),
        *[(name, _matches(pattern)) for name, pattern in POOL_KINDS.items()],
        ("checkout", _matches(CHECKOUT)),
    ]
    lines = numbered_lines(dumps).select(
        "*", first_kind(tests).alias("kind"), _matches(NO_SUCH_FEATURE).alias("denies"),
        _matches(INLINE_VERSION).alias("inlines"),
    )
    # The first line stands for a text without any line of interest.
    return lines.where(
        F.col("kind").isNotNull() | F.col("denies") | F.col("inlines") | (F.col("line_no") == 0))


def _fields(lines: DataFrame) -> DataFrame:
    """Names and numbers on each line, by its kind."""
    line, kind = F.col("line"), F.col("kind")
    # name, total, used / version, vendor, expiry / user, host, client version, start
    found = (
        F.when(kind == "usage", parts(line, USAGE, 1, 2, 3))
        .when(kind == "uncounted", parts(line, UNCOUNTED, 1))
        .when(kind == "pool_permanent", parts(line, POOL_PERMANENT, 1, 3, 2, 4, 5))
        .when(kind == "pool_vendor_date", parts(line, POOL_VENDOR_DATE, 1, 3, 2, 4, 5))
        .when(kind == "pool_date_vendor", parts(line, POOL_DATE_VENDOR, 1, 3, 2, 5, 4))
        .when(kind == "checkout", parts(line, CHECKOUT, 1, 2, 4, 5))
        .when(kind == "up", parts(line, SERVER_UP, 1, 2))
    )
    is_pool, is_checkout = kind.isin(list(POOL_KINDS)), kind == "checkout"
    lines = lines.select(
        "dump_id", "host", "captured_at", "line_no", "kind", "denies", found.alias("found"),
        F.when(F.col("inlines"), parts(line, INLINE_VERSION, 1, 2)).alias("inline"),
    )

    def part(place: int) -> Column:
        return F.get("found", F.lit(place))

    def number(place: int) -> Column:
        return F.coalesce(part(place).try_cast("int"), F.lit(0))

    lines = lines.withColumn("clock", flexlm_clock(F.when(is_checkout, stripped(part(3)))))
    return lines.select(
        "dump_id", "host", "captured_at", "line_no", "kind", "denies",
        F.when(kind.isin("usage", "uncounted") | is_pool, stripped(part(0))).alias("name"),
        F.when((kind == "usage") | is_pool, number(1)).otherwise(0).alias("total"),
        F.when(kind == "usage", number(2)).otherwise(0).alias("used"),
        F.when(is_pool, part(2)).alias("pool_version"), F.when(is_pool, part(3)).otherwise("").alias("vendor"),
        F.when(is_pool, part(4)).alias("expiry_text"),
        F.get("inline", F.lit(0)).alias("inline_name"), F.get("inline", F.lit(1)).alias("inline_version"),
        F.when(kind == "up", F.substring_index(part(0), ".", 1)).alias("master"),
        F.when(kind == "up", part(1)).alias("server_version"),
        F.when(is_checkout, stripped(part(0))).alias("username"),
        F.when(is_checkout, stripped(part(1))).alias("user_host"),
        F.when(is_checkout, stripped(part(2))).alias("client_version"),
        clock_time(F.col("clock"), F.col("captured_at")).alias("started"),
    )


def read_lines(dumps: DataFrame) -> DataFrame:
    """The lines of interest with their fields: all that the texts are needed for. Settled, they serve the status, the
    pools and the checkouts of the same texts."""
    return _fields(_classified(dumps))


def _in_context(lines: DataFrame) -> DataFrame:
    """Lines of interest up to the first fatal one, with the state the lines above them left."""
    kind, name = F.col("kind"), F.col("name")
    whole = in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # A "no such feature" line concerns the usage line above it, once.
    named_last = carried(F.when(F.col("denies"), "").when(kind == "usage", name))
    current = carried(F.when(kind.isin("usage", "uncounted"), name))
    fatal_line = F.min(F.when(kind.isin(list(FATAL)), F.col("line_no"))).over(whole)
    lines = lines.select(
        "*", named_last.alias("named_last"), current.alias("current"), fatal_line.alias("fatal_line"))

    denied = F.col("denies") & (F.coalesce("named_last", F.lit("")) != "")
    early = F.coalesce(kind.isin("up", "usage", *FATAL), F.lit(False))
    inline = F.col("inline_name").isNotNull() & F.col("current").isNotNull() & ~early
    matches = inline & (lowered(F.col("inline_name")) == lowered(F.col("current")))
    # The first line stays in any case: it stands for a text without any line of interest.
    lines = (
        lines.where(F.col("fatal_line").isNull() | (F.col("line_no") <= F.col("fatal_line")))
        .withColumn("effective", F.when(denied, "removal").when(inline, "inline").otherwise(kind))
        .withColumn("inline_version", F.when(~denied & matches, F.col("inline_version")))
        .withColumn("name", F.when(denied, F.col("named_last")).otherwise(name))
        .drop("kind", "inline_name", "named_last", "denies").withColumnRenamed("effective", "kind")
        .where(kind.isNotNull() | (F.col("line_no") == 0))
    )
    block_version = carried(F.when(kind == "usage", "").otherwise(F.col("inline_version")))
    return lines.withColumn("block_version", F.coalesce(block_version, F.lit("")))


def flexlm_status(dumps: DataFrame) -> DataFrame:
    return status_of(read_lines(dumps))


def status_of(lines: DataFrame) -> DataFrame:
    """One row per text; a text without an answer of the server means down."""
    kind = F.col("kind")
    up_at = F.when(kind == "up", F.col("line_no"))
    seen = _in_context(lines).groupBy("dump_id", "host", "captured_at").agg(
        F.max_by("master", up_at).alias("master"), F.max_by("server_version", up_at).alias("version"),
        F.max(F.when(kind.isin(list(FATAL)), kind)).alias("fatal"),
    )
    service = F.when(F.col("version").isNotNull(), "up").otherwise("down")
    message = F.lit("")
    for name, (_, state, text) in FATAL.items():
        service = F.when(F.col("fatal") == name, state).otherwise(service)
        message = F.when(F.col("fatal") == name, F.concat(F.lit(text), "host")).otherwise(message)
    return seen.select(
        "dump_id", F.col("host").alias("hostname"), service.alias("service"),
        F.coalesce("master", F.lit("")).alias("master"), F.coalesce("version", F.lit("")).alias("version"),
        message.alias("message"),
        F.col("captured_at").alias("last_checked"),
    ).select(*STATUS_COLUMNS)


def _attributed(lines: DataFrame) -> DataFrame:
    """Lines keyed by feature, with what the whole text says about that feature.

    Checkouts get their license version here: of their block, else of a block of the feature, else of a
    block of the feature in other case, else the only version among the feature's pools.
    """
    kind, at = F.col("kind"), F.col("line_no")
    rows = (
        _in_context(lines)
        .withColumn("key", F.when(kind.isin("inline", "checkout"), F.col("current")).otherwise(F.col("name")))
        .where(F.col("key").isNotNull() & ((kind != "checkout") | F.col("started").isNotNull()))
        .withColumn("folded", lowered(F.col("key")))
    )
    # One order serves both: a feature is part of the features of its name in any case.
    feature = Window.partitionBy("dump_id", "folded", "key")
    any_case = Window.partitionBy("dump_id", "folded")
    is_pool = kind.isin(list(POOL_KINDS))
    usage_at = F.when(kind == "usage", at)
    inline_at = F.when(F.col("inline_version").isNotNull(), at)
    rows = rows.select(
        "*",
        F.coalesce(F.max(F.when(kind == "removal", at)).over(feature), F.lit(-1)).alias("removed_at"),
        F.max_by("inline_version", inline_at).over(feature).alias("feature_version"),
        F.max(usage_at).over(feature).alias("usage_line"),
        F.max_by("total", usage_at).over(feature).alias("usage_total"),
        F.max_by("used", usage_at).over(feature).alias("usage_used"),
        F.max(F.when(kind == "uncounted", at)).over(feature).alias("uncounted_line"),
        F.max(F.when(is_pool, at)).over(feature).alias("pool_line"),
        F.count_if(kind == "checkout").over(feature).alias("by_name"),
    )
    live_version = F.when(is_pool & (at > F.col("removed_at")), F.col("pool_version"))
    rows = rows.select(
        "*", F.min(live_version).over(any_case).alias("least_version"),
        F.max(live_version).over(any_case).alias("most_version"),
        F.max_by("inline_version", inline_at).over(any_case).alias("folded_version"),
    )
    only_version = F.when(F.col("least_version") == F.col("most_version"), F.col("least_version"))
    backfilled = F.coalesce("feature_version", "folded_version", only_version, F.lit(""))
    own = F.nullif(F.col("block_version"), F.lit(""))
    # After a fatal line nothing is filled in.
    license_version = F.when(F.col("fatal_line").isNull(), F.coalesce(own, backfilled)).otherwise(
        F.col("block_version"))
    return rows.withColumn("license_version", F.when(kind == "checkout", license_version))


def flexlm_checkouts(dumps: DataFrame) -> DataFrame:
    return checkouts_of(read_lines(dumps))


def checkouts_of(lines: DataFrame) -> DataFrame:
    return _attributed(lines).where(F.col("kind") == "checkout").select(
        "dump_id", F.col("host").alias("server_hostname"), F.col("key").alias("feature_name"),
        "username", F.col("user_host").alias("host"), F.col("started").alias("checked_out_at"),
        F.col("client_version").alias("version"),
        "license_version",
    ).select(*CHECKOUT_COLUMNS)


def flexlm_features(dumps: DataFrame) -> DataFrame:
    return features_of(read_lines(dumps))


def features_of(lines: DataFrame) -> DataFrame:
    """License pools per text: license-file lines by (name, version, expiry), uncounted features, and
    features only a usage line names. Used licenses follow the checkouts of the pool's version, else the
    usage line in proportion to the pool."""
    kind, at, removed = F.col("kind"), F.col("line_no"), F.col("removed_at")
    is_pool = kind.isin(list(POOL_KINDS))

    def survives(last_line: str) -> Column:
        return F.coalesce(F.col(last_line) > removed, F.lit(False))

    rows = _attributed(lines).where(F.col("fatal_line").isNull())
    usage_only = (
        (kind == "usage") & (at == F.col("usage_line")) & survives("usage_line") & ~survives("pool_line")
        & ~survives("uncounted_line")
    )
    uncounted = (kind == "uncounted") & (at == F.col("uncounted_line")) & survives("uncounted_line")
    record_version = (
        F.when(is_pool, F.col("pool_version"))
        .when(usage_only, F.coalesce("feature_version", F.lit("")))
        .when(uncounted, "")
        .when(kind == "checkout", F.col("license_version"))
    )
    # Checkouts are grouped along and counted, then only the groups of pools stay. The groups come in the order that the
    # count over those of one version needs.
    same_version = Window.partitionBy("dump_id", "folded", "key", "record_version")
    in_pool = (is_pool & (at > removed)) | usage_only | uncounted
    pools = (
        rows.withColumn("record_version", record_version).withColumn("in_pool", F.coalesce(in_pool, F.lit(False)))
        .where(F.col("in_pool") | (kind == "checkout"))
        .withColumn("expires", F.when(is_pool, expiry_timestamp(F.col("expiry_text"))))
        .groupBy("dump_id", "folded", "key", "record_version", "host", "captured_at", "expires")
        .agg(
            F.bool_or("in_pool").alias("in_pool"), F.count_if(kind == "checkout").alias("holders"),
            F.sum(F.when(kind == "uncounted", UNCOUNTED_LICENSES).otherwise(F.col("total"))).alias("pool_total"),
            F.min_by("vendor", F.when(F.col("in_pool"), at)).alias("vendor_daemon"),
            F.max(F.when(kind == "usage", F.col("used")).otherwise(0)).alias("base_used"),
            F.max(F.when(survives("usage_line"), F.col("usage_total"))).alias("usage_total"),
            F.max(F.when(survives("usage_line"), F.col("usage_used"))).alias("usage_used"),
            F.max("by_name").alias("by_name"),
        )
        .withColumn("by_version", F.sum("holders").over(same_version)).where("in_pool")
    )
    # The guard inside the division keeps it safe wherever the planner evaluates it.
    share = F.expr("(cast(usage_used as bigint) * pool_total) div nullif(usage_total, 0)")
    used = (
        F.when(F.col("by_version") > 0, F.col("by_version"))
        .when(F.col("record_version") == "", F.when(F.col("by_name") > 0, F.col("by_name"))
              .otherwise(F.col("base_used")))
        .when(F.col("usage_total") > 0, F.least(share, F.col("pool_total")))
        .otherwise(F.col("base_used"))
    )
    return pools.select(
        "dump_id", F.col("host").alias("server_hostname"), F.col("key").alias("name"),
        F.col("record_version").alias("version"), "vendor_daemon",
        F.col("pool_total").cast("int").alias("total_licenses"), used.cast("int").alias("used_licenses"),
        F.col("expires").alias("expiration_date"), F.col("captured_at").alias("last_updated"),
    ).select(*FEATURE_COLUMNS)
