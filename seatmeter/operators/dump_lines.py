"""Shared steps of status-text extraction: lines, order within a text, checkout layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHECKOUT_COLUMNS = ["dump_id", "server_hostname", "feature_name", "username", "host", "checked_out_at", "version",
                    "license_version"]
FEATURE_COLUMNS = ["dump_id", "server_hostname", "name", "version", "vendor_daemon", "total_licenses",
                   "used_licenses", "expiration_date", "last_updated"]
STATUS_COLUMNS = ["dump_id", "hostname", "service", "master", "version", "message", "last_checked"]


def whole_text():
    """All lines of a text. A text is one row of the input, so no group outgrows a single value, and the
    hash partitioning by dump_id also serves every finer grouping that follows."""
    return Window.partitionBy("dump_id")


def numbered_lines(dumps: DataFrame) -> DataFrame:
    """The lines of each text, blank ones left out; the first stays in any case and stands for its text."""
    lines = dumps.select(
        "dump_id", "host", "captured_at", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line")
    )
    return lines.where((F.col("line_no") == 0) | (F.trim("line") != ""))


def with_computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """`rows` with further columns, each computed once a row. The planner moves a filter on a projected column below the
    projection, where it computes the column again, and again what that is made of; past a generator it moves none."""
    return rows.select("*", F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))))


def first_kind(tests: list[tuple[str, Column]]) -> Column:
    """Name of the first test that holds, NULL when none does."""
    kind = F.lit(None).cast("string")
    for name, test in reversed(tests):
        kind = F.when(test, F.lit(name)).otherwise(kind)
    return kind


def in_order():
    """The lines of a text from first to last."""
    return whole_text().orderBy("line_no")


def carried(value: Column) -> Column:
    """Latest non-NULL value on the lines above."""
    above = in_order().rowsBetween(Window.unboundedPreceding, -1)
    return F.last(value, ignorenulls=True).over(above)


def parts(line: Column, pattern: str, *numbers: int) -> Column:
    """The given groups of a pattern's first match as one array, found by a single run of the pattern.

    A group number 0 stands for an empty element.
    """
    mark = "\u0001"
    kept = mark.join(f"${n}" if n else "" for n in numbers)
    start = "" if pattern.startswith("^") else "(?s:^.*?)"
    return F.split(F.regexp_replace(line, f"{start}{pattern}(?s:.*)$", kept), mark)


def group(line: Column, pattern: str, number: int) -> Column:
    return F.regexp_extract(line, pattern, number)


def count_at(line: Column, pattern: str, number: int) -> Column:
    return F.coalesce(F.nullif(group(line, pattern, number), F.lit("")).try_cast("int"), F.lit(0))


def lowered(text: Column) -> Column:
    """Lower case. The planner's own function takes microseconds, so it gets only texts in which something may change."""
    return F.when(text.rlike(r"[^\x20-\x40\x5b-\x7e]"), F.lower(text)).otherwise(text)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")
