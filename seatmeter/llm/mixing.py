"""Mixing sources to target weights: temperature mixing with budgeted block permutations.

A source with the share s of all tokens gets the weight s^a / sum(s^a). The exponent a in [0, 1] is the largest (the
closest to the sources' own shares) whose weights reach the wanted entropy, unless the repetition limit asks for a
larger one. It is found by narrowing an interval: a pass evaluates 33 exponents in one aggregation over the table of
sources, so that table stays distributed and eight passes give twelve digits.

A source's weight times the budget is its number of tokens. It is taken as whole epochs, then as the beginning of one
more: every epoch is a permutation of the source's rows by a hash of row and epoch, and the last one ends before the
row that would exceed the budget. The end is found exactly: 1,024 hash ranges per source are summed, and only rows of
the range in which the budget ends are looked at one by one. A hot source is thereby summed on the map side and never
sorted. Equal rows have equal hashes; if the budget ends among them, the end is found in the same way once more, by a
hash of their row numbers, so the tokens taken fall short of the budget by less than one row whatever the copies. Each copy also gets a block: all blocks hold the sources by their weights, and `place` orders a block.

Without a budget, the smallest one is taken at which every row is read at least once.

Tokens are words here (`[^\\x20\\x09-\\x0D]+`), not those of a vocabulary that a later stage may count.

Defined cases: a null source is a source of its own; null texts have no tokens. A source without any token is taken
once and costs nothing. Null ids are allowed. Extra columns pass through `mixed`. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seatmeter.llm.common import settled, spare, whole, words

BUCKET_BITS = 10
CUTS, PASSES = 32, 8


@dataclass(frozen=True)
class Targets:
    """`entropy` is a share of the largest possible entropy; `epochs` limits how often a row is read."""

    entropy: float | None = 0.95
    epochs: float | None = 2.0
    budget: float | None = None
    blocks: int = 64


def _row_hash(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key).cast("string"), whole(text))


def _turn(row: Column, epoch: Column | str) -> Column:
    """Place of a row in the permutation of an epoch."""
    return F.xxhash64(row, F.col(epoch).cast("long") if isinstance(epoch, str) else epoch.cast("long"))


def largest_exponent(sources: DataFrame, targets: Targets) -> tuple[float, float]:
    """(exponent, sum of share^exponent) for `sources` with a column share above zero."""
    top, low, count = sources.agg(F.max("share"), F.min("share"), F.count("*")).first()
    if not count:
        return 1.0, 1.0

    def at(exponents: list[float]) -> list[tuple[float, float]]:
        """(sum of s^a, entropy) of each exponent."""
        log, aggs = F.log("share"), []
        for a in exponents:
            aggs += [F.sum(F.exp(a * log)), F.sum(F.exp(a * log) * a * log)]
        got = sources.agg(*aggs).first()
        return [(z, math.log(z) - weighted / z) for z, weighted in zip(got[::2], got[1::2])]

    def budget_share(a: float, z: float) -> float:
        return targets.budget if targets.budget is not None else top ** (1 - a) * z

    def narrowed(ok) -> tuple[float, float]:
        """The interval in which `ok` changes; ok(a, z, entropy) does not change more than once."""
        left, right = 0.0, 1.0
        for _ in range(PASSES):
            grid = [left + (right - left) * k / CUTS for k in range(CUTS + 1)]
            good = [ok(a, z, h) for a, (z, h) in zip(grid, at(grid))]
            change = next((k for k in range(CUTS) if good[k] != good[k + 1]), None)
            if change is None:
                return (grid[-1], grid[-1]) if good[-1] else (grid[0], grid[0])
            left, right = grid[change], grid[change + 1]
        return left, right

    exponent = 1.0
    if targets.entropy is not None:
        wanted = targets.entropy * math.log(count)
        exponent = narrowed(lambda a, z, h: h >= wanted)[0]
    elif targets.epochs is not None:
        exponent = 0.0
    if targets.epochs is not None:
        least = narrowed(lambda a, z, h: budget_share(a, z) * low ** (a - 1) / z <= targets.epochs)[1]
        exponent = max(exponent, least)
    return exponent, at([exponent])[0][0]


def _ends(turned: DataFrame) -> DataFrame:
    """(s, cutoff, before): per source the first turn at which the tokens exceed `left`, and the tokens before it.
    Sources that stay within it are not there. `turned` has s, left, tokens and turn."""
    turned = turned.withColumn("bucket", F.shiftright("turn", 64 - BUCKET_BITS).cast("int"))
    by_range = turned.groupBy("s", "bucket").agg(F.sum("tokens").alias("tokens"), F.max("left").alias("left"))
    running = F.sum("tokens").over(W.partitionBy("s").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    ends = (by_range.withColumn("upto", running)
            .where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("tokens") <= F.col("left")))
            .select(F.col("s").alias("e_s"), F.col("bucket").alias("e_bucket"),
                    (F.col("upto") - F.col("tokens")).alias("before")))
    last = turned.join(ends, F.col("s").eqNullSafe(F.col("e_s")) & (F.col("bucket") == F.col("e_bucket")))
    last = last.groupBy("s", "bucket", "turn").agg(
        F.sum("tokens").alias("tokens"), F.max("left").alias("left"), F.max("before").alias("before"))
    upto = F.sum("tokens").over(W.partitionBy("s").orderBy("turn").rowsBetween(W.unboundedPreceding, 0))
    # Where a range ends beyond the budget, one of its hashes is the first that does not fit.
    return (last.withColumn("upto", F.col("before") + upto).where("upto > left").groupBy("s")
            .agg(F.min(F.struct("turn", (F.col("upto") - F.col("tokens")).alias("before"))).alias("first"))
            .select("s", F.col("first.turn").alias("cutoff"), F.col("first.before").alias("before")))


def plan(rows: DataFrame, targets: Targets = Targets()) -> DataFrame:
    """Per source: tokens, weight, rate (epochs with fraction), epochs (whole ones), partly (whether one more
    begins), cutoff (the hash before which that one ends; null: none exceeds the budget) and tied (among rows of that
    hash, the hash of the row number before which it ends).

    `rows` has source, row (hash of a row), number (of its own) and tokens.
    """
    sums = settled(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")), "mixing-sources")
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    shares = settled(sums.where("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(max(total, 1)))),
                     "mixing-shares")
    relative = Targets(targets.entropy, targets.epochs,
                       None if targets.budget is None else targets.budget / max(total, 1), targets.blocks)
    exponent, z = largest_exponent(shares, relative)
    top = shares.agg(F.max("share")).first()[0] or 1.0
    budget = total * (top ** (1 - exponent) * z if relative.budget is None else relative.budget)
    weighted = (shares.withColumn("weight", F.pow("share", F.lit(exponent)) / F.lit(z))
                .withColumn("rate", F.col("weight") * F.lit(float(budget)) / F.col("tokens"))
                .withColumn("epochs", F.floor(F.col("rate") + 1e-9).cast("long"))
                .withColumn("left", F.greatest(F.lit(0.0), (F.col("rate") - F.col("epochs")) * F.col("tokens"))))
    weighted = settled(weighted.select("source", "tokens", "weight", "rate", "epochs", "left"), "mixing-weights")

    open_ = weighted.where("left > 0").select(F.col("source").alias("s"), "epochs", "left")
    turned = rows.join(open_, F.col("source").eqNullSafe(F.col("s"))).select(
        "s", "left", "tokens", _turn(F.col("row"), "epochs").alias("turn"), "number")
    cutoffs = settled(_ends(turned), "mixing-ends")
    # Equal rows at the end: as many of them as fit, by their numbers.
    tied = turned.join(cutoffs.select(F.col("s").alias("c_s"), "cutoff", "before"),
                       F.col("s").eqNullSafe(F.col("c_s")) & (F.col("turn") == F.col("cutoff")))
    tied = _ends(tied.select("s", (F.col("left") - F.col("before")).alias("left"), "tokens",
                             F.xxhash64("number").alias("turn")))
    cutoffs = cutoffs.select(F.col("s").alias("c_s"), "cutoff").join(
        tied.select(F.col("s").alias("t_s"), F.col("cutoff").alias("tied")), F.col("c_s").eqNullSafe(F.col("t_s")), "left")
    out = weighted.join(cutoffs, F.col("source").eqNullSafe(F.col("c_s")), "left")
    out = out.select("source", "tokens", "weight", "rate", "epochs", (F.col("left") > 0).alias("partly"), "cutoff", "tied")
    free = sums.where("tokens = 0").select(
        "source", "tokens", F.lit(0.0).alias("weight"), F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("epochs"),
        F.lit(False).alias("partly"), F.lit(None).cast("long").alias("cutoff"), F.lit(None).cast("long").alias("tied"))
    return settled(out.union(free), "mixing-plan")


def copies(docs: DataFrame, targets: Targets = Targets(), key: str = "doc_id", source: str = "source",
           text: str = "text", kept: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The columns `kept` (all) of `docs` with one row per copy, and the names of those appended for epoch, block and
    place."""
    kept = kept or docs.columns
    names = {n: spare(docs.columns, n) for n in (
        "row_hash", "tokens", "number", "epoch", "block", "place",
        "p_source", "p_rate", "p_epochs", "p_partly", "p_cutoff", "p_tied")}
    # Written once, so that a row keeps its number.
    docs = settled(docs.withColumns({
        names["row_hash"]: _row_hash(key, text), names["tokens"]: F.size(words(whole(text))).cast("long"),
        names["number"]: F.monotonically_increasing_id()}).select(
            *kept, *[names[n] for n in ("row_hash", "tokens", "number")]), "mixing-rows")
    rows = docs.select(F.col(source).alias("source"), F.col(names["row_hash"]).alias("row"),
                       F.col(names["number"]).alias("number"), F.col(names["tokens"]).alias("tokens"))
    chosen = plan(rows, targets).select(*[
        F.col(n).alias(names[f"p_{n}"]) for n in ("source", "rate", "epochs", "partly", "cutoff", "tied")])
    row, epochs = F.col(names["row_hash"]), F.col(names["p_epochs"])
    turn, cutoff = _turn(row, epochs), F.col(names["p_cutoff"])
    fits = (turn < cutoff) | (turn == cutoff) & (F.xxhash64(names["number"]) < F.col(names["p_tied"]))
    more = F.col(names["p_partly"]) & (cutoff.isNull() | fits)
    times = epochs + more.cast("long")
    out = (docs.join(chosen, F.col(source).eqNullSafe(F.col(names["p_source"])))
           .withColumn(names["epoch"], F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1)))))
    position = (F.col(names["epoch"]) + (_turn(row, names["epoch"]) / F.lit(float(1 << 64)) + 0.5)) / F.col(names["p_rate"])
    out = out.withColumn(names["block"], F.least(F.floor(position * targets.blocks), F.lit(targets.blocks - 1)).cast("int"))
    return out.withColumn(names["place"], F.xxhash64(row, F.col(names["epoch"]), F.lit("place"))), names


def mixed(docs: DataFrame, targets: Targets = Targets(), key: str = "doc_id", source: str = "source",
          text: str = "text") -> DataFrame:
    """The rows of the mixture, with the columns they came with; a row read twice is there twice. Written, the files
    hold one block after the other, each in the order of its places."""
    out, names = copies(docs, targets, key, source, text)
    order = [names["block"], names["place"]]
    return out.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)


def mixing_report(docs: DataFrame, targets: Targets = Targets(), key: str = "doc_id", source: str = "source",
                  text: str = "text") -> DataFrame:
    """One row per copy: key, source, epoch, block, place."""
    out, names = copies(docs.select(*dict.fromkeys([key, source, text])), targets, key, source, text,
                        list(dict.fromkeys([key, source])))
    return out.select(key, source, *[F.col(names[n]).alias(n) for n in ("epoch", "block", "place")])
