"""The domain tables, derived from the star-schema test tables `events` and `nation`.

Every event is read as one poll of one license pool: its nation is the license server, its event type the
feature. All views are plain projections of `events` joined to the 25 nations (the planner broadcasts the
nations by their file size); nothing is cut, sampled or cached.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seatmeter.functions import metrics as m
from seatmeter.operators.inventory import inventory_from_polls, latest_pools
from seatmeter.operators.usage import samples_from_polls

AS_OF = datetime(2024, 1, 31, 12, 0, 0)
IN_SERVICE_SINCE = datetime(2024, 1, 1)
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
NATION = "n_nationkey int, n_name string, n_regionkey int"


def _hostname(name: Column) -> Column:
    return F.concat(F.lit("27000@"), F.lower(F.replace(name, F.lit("_"), F.lit("-"))), F.lit(".example.com"))


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(NATION).parquet(f"{sf_dir}/nation.parquet")


def _server_type(key: Column) -> Column:
    return F.when(key % 3 == 0, "rlm").otherwise("flexlm")


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _polls_of(spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet"), spark, sf_dir)


def stream_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same polls as a stream over the event files."""
    # A pattern that only the table matches: it may be a file or a folder of part files, and a stream takes no file path.
    events = spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events.parque[t]")
    return _polls_of(events, spark, sf_dir)


def _polls_of(events: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _nation(spark, sf_dir).select("n_nationkey", "n_name")
    joined = events.join(nation, F.col("user_id") % 25 == F.col("n_nationkey"))
    key, k = F.col("n_nationkey"), F.get_json_object("props", "$.k").cast("int")
    joined = joined.select(
        F.col("event_id").alias("poll_id"), "user_id", "event_type", "value",
        F.col("ts").cast("timestamp").alias("sampled_at"), key, "n_name", k.alias("k"),
    )
    k = F.col("k")
    return joined.select(
        "poll_id", "user_id", "k", _hostname(F.col("n_name")).alias("server_hostname"),
        _server_type(key).alias("server_type"), F.col("event_type").alias("feature_name"),
        F.col("event_type").alias("name"), F.concat(F.lit("v"), k % 3).alias("version"),
        F.concat(F.lit("vd"), key % 2).alias("vendor_daemon"),
        F.when(key == 14, 0).otherwise(60 + 60 * (key % 5)).cast("int").alias("total_licenses"),
        F.floor("value").cast("int").alias("used_licenses"),
        F.when(k % 10 != 0, F.date_add(F.lit("2024-01-31").cast("date"), k - 20)).cast("timestamp")
        .alias("expiration_date"),
        F.date_trunc("day", "sampled_at").alias("polled_at"), "sampled_at",
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory_from_polls(polls(spark, sf_dir))


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory without the active flag, for readers that do not ask for it: one scan less."""
    return latest_pools(polls(spark, sf_dir))


def feature_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples_from_polls(polls(spark, sf_dir))


def servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _nation(spark, sf_dir)
    key = F.col("n_nationkey")
    return nation.select(
        key.cast("bigint").alias("id"), _hostname(F.col("n_name")).alias("hostname"),
        F.col("n_name").alias("description"), _server_type(key).alias("type"),
        F.concat(F.lit("c"), key).alias("cacti_id"), F.concat(F.lit("https://web-"), key).alias("webui"),
        m.moment(IN_SERVICE_SINCE).alias("created_at"), m.moment(AS_OF).alias("updated_at"),
    )


def license_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = polls(spark, sf_dir)
    kind = F.col("feature_name")
    denied = kind == "error"
    return log.select(
        F.col("poll_id").alias("id"), F.to_date("sampled_at").alias("event_date"),
        F.date_format("sampled_at", "HH:mm:ss").alias("event_time"),
        F.when(denied, "DENIED").when(kind.isin("view", "signup"), "OUT").otherwise("IN").alias("event_type"),
        F.concat(F.lit("tool"), F.col("k") % 10).alias("feature_name"),
        F.concat(F.lit("user"), "user_id").alias("username"),
        F.when(denied, F.concat(F.lit("reason "), F.col("k") % 3)).otherwise("").alias("reason"),
    )


def tool_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polls as those of the tools that the license events name, each server holding a few licenses of a tool."""
    return polls(spark, sf_dir).select(
        "poll_id", "server_hostname", F.concat(F.lit("tool"), F.col("k") % 10).alias("feature_name"), "sampled_at",
        F.floor(F.col("total_licenses") / 4).cast("int").alias("total_licenses"),
        F.least(F.floor(F.col("total_licenses") / 4), "used_licenses").cast("int").alias("used_licenses"))


def checkouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polls(spark, sf_dir).select(
        "server_hostname", "feature_name", F.concat(F.lit("user"), "user_id").alias("username"),
        F.concat(F.lit("host"), F.col("user_id") % 40).alias("host"), F.col("sampled_at").alias("checked_out_at"),
        F.concat(F.lit("2024."), F.col("k") % 4).alias("version"), F.col("version").alias("license_version"),
    )


def earlier_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log stored before: all samples, those with odd ids a day earlier."""
    return feature_usage(spark, sf_dir).withColumn(
        "date", F.date_sub("date", F.when(F.col("id") % 2 == 1, 1).otherwise(0)))


def held_checkouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checkouts; only users ending in 7 hold a license of a version that is in the inventory."""
    return checkouts(spark, sf_dir).withColumn(
        "license_version", F.when(F.endswith("username", F.lit("7")), F.col("license_version")).otherwise("v9"))


def moved_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All servers; those with odd ids are configured under a new name only."""
    moved = F.concat(F.lit("moved-"), "hostname")
    return servers(spark, sf_dir).withColumn("hostname", F.when(F.col("id") % 2 == 1, moved).otherwise(F.col("hostname")))


def live_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All polls as live answers; flexlm servers answer under the names of their standbys."""
    standby = F.concat(F.lit("standby-"), "server_hostname")
    return polls(spark, sf_dir).withColumn(
        "server_hostname", F.when(F.col("server_type") == "flexlm", standby).otherwise(F.col("server_hostname")))


def dump_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One FlexLM text per poll in one of eight forms that `dumps` has not: answers that fail, checkouts whose license
    version has to be found elsewhere, license files with the expiry before the vendor, other dates, and full years."""
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    log = polls(spark, sf_dir).withColumn("dump_id", F.col("poll_id").cast("string")).repartition(count, "dump_id")
    k, f, vd, total = F.col("k"), F.col("feature_name"), F.col("vendor_daemon"), F.col("total_licenses")
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    up = line("    lic", k % 3, ".example.com: license server UP (MASTER) v11.19.", k % 4)

    def usage(name: Column) -> Column:
        return line("Users of ", name, ":  (Total of ", total, " licenses issued;  Total of ", F.col("used_licenses"),
                    " licenses in use)")

    def holder(user: str, start: Column) -> Column:
        return line("    ", user, " pc /dev/tty (v9) (lic/27000 1), start ", start)

    start = line("Mon ", F.date_format("sampled_at", "M/d H:mm"))
    forms = [
        [up, "Cannot read data from license server", usage(f)],
        [up, usage(f), "Error getting status: timed out", line(f, " 1.0 4 vd permanent")],
        [up, usage(f), holder("ann", start), line('  "', f, '" v3.1, vendor: ', vd)],
        [up, usage(f), line('  "', f, '" v4.2, vendor: ', vd), usage(F.upper(f)), holder("bob", start)],
        [up, usage(f), holder("cy", start), line(f, " 7.0 ", total, " ", vd, " 20-jun-2026"),
         line(F.upper(f), " 7.0 5 1-jul-2026 ", vd)],
        [up, usage(f), holder("dan", start), line(f, " 1.0 2 ", vd, " permanent"), line(f, " 2.0 3 1-jan-0 ", vd)],
        [up, line(f, " 1.0 4 2026-03-15 ", vd), line(f, " 2.0 4 5-xyz-2026 ", vd), line(f, " 3.0 4 1-jan-0000"),
         line(f, " 4.0 4 09-nov-2027 ", vd)],
        [usage(f), holder("eve", line("Mon ", F.date_format("sampled_at", "M/d/yyyy H:mm"))), holder("fay", F.lit("Tue 2/3/98 7:05")),
         holder("gus", F.lit("Wed 4/5/24 17:30")), holder("hal", F.lit("Someday 4/5 17:30"))],
    ]
    text = F.lit("")
    for number, lines in enumerate(forms):
        text = F.when(k % 8 == number, F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])).otherwise(text)
    return log.select("dump_id", F.col("server_hostname").alias("host"), F.lit("flexlm").alias("server_type"),
                      F.col("sampled_at").alias("captured_at"), text.alias("text"))


def other_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All status texts; every fifth is of a type without an extraction, and some of those of none."""
    number = F.col("dump_id").cast("long")
    kind = F.when(number % 15 == 0, F.lit(None)).when(number % 5 == 0, "spm").otherwise(F.col("server_type"))
    return dumps(spark, sf_dir).withColumn("server_type", kind)


def redirected_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All status texts; those of each seventh nation come from a host that is not configured."""
    silent = servers(spark, sf_dir).where(F.col("id") % 7 == 0).select(F.col("hostname").alias("host"), F.lit(True).alias("silent"))
    texts = dumps(spark, sf_dir).join(silent, "host", "left")
    return texts.withColumn("host", F.when(F.col("silent"), F.concat(F.lit("spare-"), "host")).otherwise(F.col("host"))) \
        .drop("silent")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored alert per pool that expired within ten days of its last poll; even ids were sent."""
    seen, expires = F.col("last_updated"), F.col("expiration_date")
    days = m.days_until(expires, seen)
    sent = F.col("id") % 2 == 0
    due = features(spark, sf_dir).where((expires > seen) & (expires <= seen + F.make_dt_interval(F.lit(10))))
    return due.select(
        "id", "server_hostname", F.col("name").alias("feature_name"), F.lit("expiration").alias("alert_type"),
        m.alert_message(F.col("name"), F.col("server_hostname"), days, expires).alias("message"),
        m.alert_severity(days).alias("severity"), sent.alias("sent"),
        F.when(sent, seen + F.make_dt_interval(mins=F.lit(5))).alias("sent_at"), seen.alias("created_at"),
    )


def alert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last alert of every server: half an hour ago for even nations, 90 minutes for odd ones."""
    nation = _nation(spark, sf_dir)
    key = F.col("n_nationkey")
    minutes = F.when(key % 2 == 0, 30).otherwise(90)
    return nation.select(
        key.cast("bigint").alias("id"), (m.moment(AS_OF) - F.make_dt_interval(mins=minutes)).alias("datetime"),
        F.lit("expiration").alias("type"), _hostname(F.col("n_name")).alias("hostname"),
    )


def _repeated(count: Column, line) -> Column:
    """Lines 1..count as one text, empty for count 0."""
    return F.array_join(F.transform(F.filter(F.sequence(F.lit(1), F.lit(9)), lambda i: i <= count), line), "\n")


def dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One status text per poll, rendered from the poll alone, in the form of its server's type.

    k steers the variants: unreachable servers, a stopped vendor daemon, case differences, removed,
    uncounted and version-less features, one to three license-file lines, zero to three checkouts.
    """
    # The polls are dealt out before their texts are rendered: the test tables are one small file, and rendering and
    # reading texts is the work. Stored texts come in many files and are not shuffled.
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    log = polls(spark, sf_dir).withColumn("dump_id", F.col("poll_id").cast("string")).repartition(count, "dump_id")
    k, feature, host = F.col("k"), F.col("feature_name"), F.col("server_hostname")
    half = F.floor(F.col("total_licenses") / 2)
    machine = F.substring_index(host, "@", -1)
    day = F.date_format("sampled_at", "M/d")
    clock = F.date_format("sampled_at", "H:mm")
    holders = _repeated(k % 4, lambda i: F.concat(
        F.lit("    user"), i, F.lit(" host"), k % 7, F.lit(" /dev/tty (v2024."), k % 5, F.lit(") ("), machine,
        F.lit("/27000 "), F.lit(100) + i, F.lit("), start Mon "), day,
        F.when(k % 2 == 0, "/24").otherwise(""), F.lit(" "), clock))
    flexlm = F.concat_ws(
        "\n",
        F.lit("lmstat - status report"),
        F.concat(F.lit("License server status: "), host),
        F.when(k % 20 != 0, F.concat(F.lit("    "), machine, F.lit(": license server UP (MASTER) v11.18."), k % 4)),
        F.when(k % 20 == 0, F.lit("Cannot connect to license server system.")),
        F.concat(F.lit("Users of "), feature, F.lit(":  (Total of "), F.col("total_licenses"),
                 F.lit(" licenses issued;  Total of "), F.col("used_licenses"), F.lit(" licenses in use)")),
        F.lit(""),
        F.concat(F.lit('  "'), F.when(k % 2 == 0, F.upper(feature)).otherwise(feature), F.lit('" v'), k % 3,
                 F.lit(".0, vendor: "), F.col("vendor_daemon")),
        F.lit("  floating license"),
        F.nullif(holders, F.lit("")),
        F.when(k % 20 == 1, F.lit("vendor daemon is down")),
        F.concat(F.lit("Users of ghost_"), k % 5, F.lit(":  (Total of 5 licenses issued;  Total of 1 license in use)")),
        F.concat(F.lit("ghost_"), k % 5, F.lit(" 1.0 5 vd9 permanent")),
        F.lit("No such feature exists."),
        F.concat(F.lit("Users of plain_"), k % 4, F.lit(":  (Total of 10 licenses issued;  Total of "), k % 10,
                 F.lit(" licenses in use)")),
        F.concat(F.lit("Users of free_"), k % 2, F.lit(":  (uncounted, node-locked)")),
        F.lit("License files:"),
        F.concat(feature, F.lit(" "), k % 3, F.lit(".0 "), half, F.lit(" "), F.col("vendor_daemon"),
                 F.lit(" permanent")),
        F.concat(feature, F.lit(" "), k % 3, F.lit(".0 "), F.col("total_licenses") - half,
                 F.lit(" other permanent")),
        F.concat(feature, F.lit(" 9.0 30 1-"), F.lower(F.date_format("sampled_at", "MMM")), F.lit("-2025 old")),
    )
    rlm_holders = _repeated(k % 4, lambda i: F.concat(
        feature, F.lit(" v"), k % 3, F.lit(".1: user"), i, F.lit("@host"), k % 7, F.lit(" 1/0 at "),
        F.date_format("sampled_at", "MM/dd HH:mm"), F.lit(" (handle: "), i, F.lit(")")))
    rlm = F.concat_ws(
        "\n",
        F.when(k % 20 != 0, F.concat(F.lit("rlm status on "), machine, F.lit(" (port 5053, pid 77)"))),
        F.concat(F.lit("rlm software version v15."), k % 4, F.lit(" (build 1)")),
        F.lit(""),
        F.concat(F.col("vendor_daemon"), F.lit(" 5053 "), F.when(k % 10 == 1, "No").otherwise("Yes"), F.lit(" 77")),
        F.concat(feature, F.lit(" v"), k % 3, F.lit(".1 license pool status")),
        F.concat(F.lit("  count: "), F.col("total_licenses"), F.lit(", inuse: "), F.col("used_licenses"),
                 F.lit(", exp: "), F.when(k % 2 == 0, "permanent").otherwise("31-Dec-2025")),
        F.nullif(rlm_holders, F.lit("")),
        F.lit("rlmutil v15.2 license pool status"),
        F.lit("count: 5, inuse: 2, exp: permanent"),
        F.concat(F.lit("tool_"), k % 5, F.lit(" v2.0 floating license pool")),
        F.concat(F.lit("UNCOUNTED, inuse: "), k % 9),
    )
    return log.select(
        "dump_id", host.alias("host"), "server_type",
        F.col("sampled_at").alias("captured_at"),
        F.when(F.col("server_type") == "rlm", rlm).otherwise(flexlm).alias("text"),
    )
