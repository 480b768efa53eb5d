"""Search, user-chosen order and page slices of result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT = 50
MAX_LIMIT = 500

# Sort keys of the statistics table.
STATS_SORTS = {
    "server": "server_hostname", "feature": "feature_name", "total": "total_licenses", "avg": "avg_usage",
    "peak": "peak_usage", "min": "min_usage", "utilization": "avg_utilization_pct",
}


def search(rows: DataFrame, term: str, columns: tuple[str, ...] = ("server_hostname", "feature_name")) -> DataFrame:
    """Rows where one of the columns contains the term, ignoring case; an empty term keeps all."""
    if not term:
        return rows
    hits = [F.contains(F.lower(c), F.lit(term.lower())) for c in columns]
    found = hits[0]
    for hit in hits[1:]:
        found = found | hit
    return rows.where(found)


def sorted_by(rows: DataFrame, column: str, descending: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows in the order of one column, text compared without case; `ties` fix the rest."""
    is_text = dict(rows.dtypes)[column] == "string"
    key = F.lower(column) if is_text else F.col(column)
    return rows.orderBy(key.desc() if descending else key.asc(), *ties)


def page_bounds(limit: int | None = None, offset: int | None = None, page: int | None = None) -> tuple[int, int]:
    """(limit, offset) of a request: limit 50 unless given, at most 500; an offset beats a page number."""
    size = min(limit, MAX_LIMIT) if limit and limit > 0 else DEFAULT_LIMIT
    if offset is not None and offset >= 0:
        return size, offset
    if page is not None and page > 0:
        return size, (page - 1) * size
    return size, 0


def page_of(ordered: DataFrame, limit: int, offset: int) -> DataFrame:
    """One page of ordered rows: a top-k of offset + limit rows, not a full sort."""
    return ordered.offset(offset).limit(limit)


class PageDirectory:
    """Deep pages of a large ordered table without sorting what comes before them.

    The first column of the order is turned into a number that grows with it (for text, its first bytes). One pass finds
    `ranges` borders of about equal counts, a second one counts the rows of each range; these counts, a few hundred rows
    whatever the table, are the directory, and serve any number of pages. A page then filters the ranges it lies in, which
    the file scan can prune by, and sorts only those. Where one value of the column has more rows than a range should,
    that value gets a directory over the next column of the order.

    `order`: (column, descending) pairs that fix the order completely; text compares by its bytes, without case in the
    first column if `fold`. Nulls come first, or last in a falling order.
    """

    def __init__(self, rows: DataFrame, order: list[tuple[str, bool]], ranges: int = 256, fold: bool = False) -> None:
        self.rows, self.order, self.ranges, self.fold = rows, order, ranges, fold
        self.code = _code(rows, *order[0], fold)
        borders = rows.agg(F.percentile_approx(self.code, [k / ranges for k in range(1, ranges)], 100 * ranges)).first()[0]
        self.borders = sorted(set(borders or []))
        place = F.size(F.filter(F.lit(self.borders).cast("array<double>"), lambda b: b < self.code))
        counts = {r[0]: (r[1], r[2], r[3]) for r in rows.groupBy(place.alias("range")).agg(
            F.count(F.lit(1)), F.min(self.code), F.max(self.code)).collect()}
        self.counts = [(*counts[k], k) for k in sorted(counts)]
        self.total = sum(n for n, *_ in self.counts)

    def _sorted(self, rows: DataFrame) -> DataFrame:
        first, *rest = self.order
        column = F.lower(first[0]) if self.fold else F.col(first[0])
        keys = [(column, first[1]), *((F.col(name), down) for name, down in rest)]
        return rows.orderBy(*[c.desc() if down else c.asc() for c, down in keys])

    def page(self, limit: int, offset: int) -> DataFrame:
        """The page's rows in order; empty beyond the end."""
        before, chosen = 0, []
        for count, low, high, _ in self.counts:
            if before + count > offset and before < offset + limit:
                chosen.append((before, count, low, high))
            before += count
        if not chosen:
            return self.rows.limit(0)
        start, low, high = chosen[0][0], chosen[0][2], chosen[-1][3]
        rows = self.rows.where(self.code.between(low, high))
        if len(chosen) == 1 and low == high and len(self.order) > 1 and chosen[0][1] > 2 * self.total / self.ranges + limit:
            column = F.lower(self.order[0][0]) if self.fold else F.col(self.order[0][0])
            values = rows.agg(F.min(column), F.max(column)).first()
            if values[0] == values[1]:
                return PageDirectory(rows, self.order[1:], self.ranges).page(limit, offset - start)
        return self._sorted(rows).offset(offset - start).limit(limit)


def _code(rows: DataFrame, name: str, descending: bool, fold: bool = False) -> Column:
    """A double that does not fall where the column's order does not."""
    kind, column = dict(rows.dtypes)[name], F.col(name)
    if kind == "string":
        text = F.lower(column) if fold else column
        # Six bytes are exact in a double.
        code = F.conv(F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    elif kind == "date":
        code = F.unix_date(column).cast("double")
    elif kind.startswith("timestamp"):
        code = F.unix_micros(column.cast("timestamp")).cast("double")
    else:
        code = column.cast("double")
    code = F.coalesce(code, F.lit(float("-inf")))
    return -code if descending else code


def page_info(rows: DataFrame, limit: int, offset: int) -> DataFrame:
    """One row of page data: total rows and pages, current page, the rows it spans, neighbours."""
    total = F.col("total")
    return rows.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(limit).alias("limit"), F.lit(offset).alias("offset"),
        F.lit(offset // limit + 1).alias("page"),
        F.ceil(total / F.lit(limit)).cast("long").alias("total_pages"),
        F.least(F.lit(offset + 1).cast("long"), total).alias("first_row"),
        F.least(F.lit(offset + limit).cast("long"), total).alias("last_row"),
        (F.lit(offset + limit) < total).alias("has_next"), F.lit(offset > 0).alias("has_prev"),
    )
