"""Order within a key, computed by time ranges, so that a hot key is worked on by many tasks.

A window over a whole key puts all its rows into one task. Here a key's rows are divided by day first: windows go over
(key, day), and what a day needs from the days before it (a sum, a count, a last row) is one small row per key and day,
carried over by a second window. Days whose rows are still too many can be divided by another `span`.

Key and day are one struct: structs compare null fields as equal, and window, grouping and join then use one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = "day"


def _spanned(rows: DataFrame, key: list[str], at: str, span: str) -> DataFrame:
    return rows.withColumn("_part", F.struct(F.struct(*key).alias("key"), F.date_trunc(span, F.col(at)).alias("span")))


def _edges(days: DataFrame) -> DataFrame:
    """Days with their key on its own, for a window over the days of a key."""
    return days.withColumn("_whole", F.col("_part.key"))


def running(rows: DataFrame, key: list[str], at: str, order: list[str], sums: dict[str, Column],
            span: str = DAY) -> DataFrame:
    """`rows` with running sums: all rows of the key up to and with this one, by time `at` and then `order`."""
    rows = _spanned(rows, key, at, span).withColumns({f"_{name}": value for name, value in sums.items()})
    days = _edges(rows.groupBy("_part").agg(*[F.sum(f"_{name}").alias(f"_all_{name}") for name in sums]))
    earlier = Window.partitionBy("_whole").orderBy("_part.span").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("_part", *[
        F.coalesce(F.sum(f"_all_{name}").over(earlier), F.lit(0)).alias(f"_all_{name}") for name in sums])
    within = Window.partitionBy("_part").orderBy(at, *order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumns({f"_{name}": F.sum(f"_{name}").over(within) for name in sums}).join(days, "_part")
    joined = joined.withColumns({name: F.col(f"_{name}") + F.col(f"_all_{name}") for name in sums})
    return joined.drop("_part", *[f"_{n}" for n in sums], *[f"_all_{n}" for n in sums])


def numbered(rows: DataFrame, key: list[str], at: str, order: list[str], into: str, span: str = DAY) -> DataFrame:
    """`rows` with their number within the key, from 1."""
    return running(rows, key, at, order, {into: F.lit(1).cast("long")}, span)


def _beside(rows: DataFrame, key: list[str], at: str, order: list[str], value: Column, into: str, span: str,
            back: bool) -> DataFrame:
    step, edge = (F.lag, F.max_by) if back else (F.lead, F.min_by)
    rows = _spanned(rows, key, at, span).withColumn("_value", value)
    # The edge row of each day, handed to the day after or before it.
    days = _edges(rows.groupBy("_part").agg(edge("_value", F.struct(at, *order)).alias("_edge")))
    days = days.select("_part", step("_edge").over(Window.partitionBy("_whole").orderBy("_part.span")).alias("_edge"))
    rows = rows.withColumn(into, step("_value").over(Window.partitionBy("_part").orderBy(at, *order)))
    return rows.join(days, "_part").withColumn(into, F.coalesce(into, "_edge")).drop("_value", "_edge", "_part")


def previous(rows: DataFrame, key: list[str], at: str, order: list[str], value: Column, into: str,
             span: str = DAY) -> DataFrame:
    """`rows` with `value` of the row before (a struct; null for the first row of a key)."""
    return _beside(rows, key, at, order, value, into, span, back=True)


def following(rows: DataFrame, key: list[str], at: str, order: list[str], value: Column, into: str,
              span: str = DAY) -> DataFrame:
    """`rows` with `value` of the row after (a struct; null for the last row of a key)."""
    return _beside(rows, key, at, order, value, into, span, back=False)
