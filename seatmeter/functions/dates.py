"""Dates as license servers print them, read with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The expiry given to permanent and unreadable licenses, and the shapes of readable ones
# with the format that reads each (hyphens between words are blanks by then, months are capitalized).
PERMANENT_EXPIRY = "2099-01-01 00:00:00"
EXPIRY_FORMATS = [
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d MMM yyyy"),
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy MM dd"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]+ \d{1,2} \d{4}$", "MMMM d yyyy"),
]
WEEKDAYS = "(?i)^(mon|tue|wed|thu|fri|sat|sun) "


def expiry_timestamp(text: Column) -> Column:
    """Expiry text to timestamp; empty, `permanent` and unreadable texts mean a permanent license."""
    cleaned = F.regexp_replace(text, r"^\s+|\s+$", "")
    year_zero = F.regexp_replace(F.regexp_replace(cleaned, "-jan-0000", "-jan-2036"), "-jan-0", "-jan-2036")
    words = F.initcap(F.regexp_replace(year_zero, "-", " "))
    attempts = [
        F.when(year_zero.rlike(shape), F.try_to_timestamp(words, F.lit(form))) for shape, form in EXPIRY_FORMATS
    ]
    # Every readable shape has digits; a text without any, most often `permanent`, is not tried.
    found = F.when(text.rlike(r"\d"), F.coalesce(*attempts))
    return F.coalesce(found, F.lit(PERMANENT_EXPIRY).cast("timestamp"))


def _this_year(text: Column, year: Column) -> Column:
    """`month/day hour:minute` within `year`; 29 February of a common year runs on into 1 March."""
    prefix = F.concat(year.cast("string"), F.lit("/"))
    moved_on = F.regexp_replace(text, "^0?2/29 ", "3/1 ")
    form = F.lit("yyyy/M/d H:mm")
    return F.coalesce(
        F.try_to_timestamp(F.concat(prefix, text), form), F.try_to_timestamp(F.concat(prefix, moved_on), form)
    )


def flexlm_clock(text: Column) -> Column:
    """A start as FlexLM prints it, without its weekday; NULL when it has none."""
    return F.regexp_replace(F.when(text.rlike(WEEKDAYS), F.regexp_replace(text, "^[A-Za-z]+ +", "")), " +", " ")


def clock_time(clock: Column, captured_at: Column) -> Column:
    """`1/2/2024 15:04`, `1/2/24 15:04` or `1/2 15:04`; NULL when it is none of these. `clock` is read several times, so
    it is a column that was computed before."""
    # Two-digit years up to 68 lie in this century, from 69 on in the last one.
    full = F.regexp_replace(
        F.regexp_replace(clock, r"^(\d+/\d+)/([0-5]\d|6[0-8]) ", "$1/20$2 "),
        r"^(\d+/\d+)/(69|[7-9]\d) ", "$1/19$2 ",
    )
    return (
        F.when(clock.rlike(r"^\d{1,2}/\d{1,2} \d{1,2}:\d{2}$"), _this_year(clock, F.year(captured_at)))
        .when(clock.rlike(r"^\d{1,2}/\d{1,2}/(\d{2}|\d{4}) \d{1,2}:\d{2}$"),
              F.try_to_timestamp(full, F.lit("M/d/yyyy H:mm")))
    )


def rlm_start(text: Column, captured_at: Column) -> Column:
    """`01/02 15:04` in the year of the capture; month, day and minute have two digits."""
    clock = F.regexp_replace(text, " +", " ")
    return F.when(clock.rlike(r"^\d{2}/\d{2} \d{1,2}:\d{2}$"), _this_year(clock, F.year(captured_at)))
