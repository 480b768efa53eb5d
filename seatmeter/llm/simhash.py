"""SimHash near-duplicates with vantage-point trees.

Fingerprints: 64 bits per text, a bit is the majority among the hashes of the text's word shingles. Texts link where
their fingerprints differ in at most `distance` bits; a component is a set of texts joined by links.

Search: equal fingerprints are one class from the start, so copies cost nothing further. The classes are divided by
vantage-point trees over the Hamming distance. In 64 dimensions with random bits almost every point lies within 4 bits
of a median sphere, so one tree over all bits would send most points down both branches. The bits are therefore cut
into `blocks` parts, with one tree per part: two fingerprints within `distance` bits of each other differ in at most
`distance // blocks` bits of some part, and the Hamming distance of a part is again a metric, so the triangle bounds
hold with that smaller radius. For 4 bits and three parts the radius is 1 and about a third of the points cross a
sphere. A pair separated by a sphere is found from its inner side only.

Every level of routing makes about a quarter more visitors (rows a point and tree, measured on random fingerprints: 1.4 at
depth 2, 2.7 at 5, 5.6 at 8, 9.7 at 10), so shards are large and levels few: 16 levels serve four billion fingerprints.

A bounded sample gives the upper levels of the trees (`ROUTING_SAMPLE` fingerprints at most); they deal out home points
and boundary-overlapping visitors to shards. A shard goes on dividing the same way in memory and compares what is left
exactly, over all 64 bits. It returns only links to the smallest fingerprint of each local component: linear in its
rows, however dense a group is. Shards beyond `SHARD_PAIRS` pairs are split into a grid, by home points and by asking
ones, so a group that no sphere divides is held whole by no task. There, asking points visit both sides of a sphere, as
the spheres of two parts differ.

Defined cases: null and empty texts, and texts without words, have fingerprint zero and link to each other like any
others. A text with fewer words than a shingle is one shingle. Repeated rows get equal results. Null ids are allowed;
a component's id is the smallest id that is not null (null if there is none). Extra columns pass through
`near_duplicates_removed`; the ids may have any orderable type. An empty table gives an empty table.
"""

from __future__ import annotations

from itertools import accumulate
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from seatmeter.llm.common import settled, spare
from seatmeter.llm.components import components
from seatmeter.session import attach

SHINGLE = 4
DISTANCE = 4
BLOCKS = 3
ROUTING_SAMPLE = 1 << 18      # fingerprints on the driver, 2 MB
SHARD_POINTS = 1 << 16        # wanted home points in a shard
SHARD_PAIRS = 1 << 33         # pairs a task may have to look at before its shard is split
LEAF_PAIRS = 1 << 19          # pairs compared at once


def _fingerprint(text: bytes | None, shingle: int) -> int:
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(line, 42)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends[:-shingle]]
        hashes = [xxh64_intdigest(line[a:b - 1], 42) for a, b in zip(starts, ends[shingle - 1:])]
    ones = np.zeros(64, dtype=np.int64)
    every = np.array(hashes, dtype="<u8")
    for part in range(0, len(every), 1 << 15):
        piece = every[part:part + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(piece, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(every), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The 64-bit fingerprint as a long. Lower-cases A-Z; hashes are XXH64 with seed 42."""

    @F.pandas_udf(LongType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            prints = np.fromiter((_fingerprint(t, shingle) for t in texts), dtype=np.uint64, count=len(texts))
            yield pd.Series(prints.view(np.int64))

    return run(text.cast("binary"))


def hex_digits(print_: Column) -> Column:
    return F.lower(F.lpad(F.hex(print_), 16, "0"))


def block_masks(blocks: int) -> list[np.uint64]:
    """Masks that cut the 64 bits into parts of nearly equal length."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [np.uint64((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]


def _apart(points: np.ndarray, vantage: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((points ^ vantage) & mask).astype(np.int16)


def _sphere(points: np.ndarray, mask: np.uint64, radius: int, seed: int) -> tuple[np.uint64, int] | None:
    """A vantage point and a bound dividing `points` into two real parts; of a few, the one that fewest points cross."""
    rng, best = np.random.default_rng(seed), None
    for vantage in points[rng.integers(0, len(points), 6)]:
        near = np.cumsum(np.bincount(_apart(points, vantage, mask), minlength=66))
        share = near / len(points)
        for bound in range(65):
            if not 0.25 <= share[bound] <= 0.75:
                continue
            crossing = share[min(bound + radius, 64)] - (share[bound - radius] if bound >= radius else 0)
            cost = crossing + abs(share[bound] - 0.5)
            if best is None or cost < best[0]:
                best = (cost, vantage, bound)
    return None if best is None else best[1:]


class Tree:
    """The upper levels of a vantage-point tree in arrays: node i has children 2i+1 (inside) and 2i+2 (outside)."""

    def __init__(self, sample: np.ndarray, mask: np.uint64, radius: int, depth: int):
        size = (1 << depth) - 1
        self.mask, self.radius, self.depth = mask, radius, depth
        self.vantage, self.bound = np.zeros(size, dtype=np.uint64), np.full(size, 64, dtype=np.int16)
        parts = {0: sample}
        for node in range(size):
            points = parts.pop(node)
            sphere = _sphere(points, mask, radius, node) if len(points) >= 16 else None
            if sphere:
                self.vantage[node], self.bound[node] = sphere
            inside = _apart(points, self.vantage[node], mask) <= self.bound[node]
            parts[2 * node + 1], parts[2 * node + 2] = points[inside], points[~inside]

    def routed(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of `points`, shard, at home) for the home of every point and for each shard it has to visit."""
        row, home = np.arange(len(points)), np.ones(len(points), dtype=bool)
        node = np.zeros(len(points), dtype=np.int64)
        for _ in range(self.depth):
            d, t = _apart(points[row], self.vantage[node], self.mask), self.bound[node]
            inside = d <= t
            inner = np.where(home, inside, d - self.radius <= t)
            outer = np.where(home, ~inside, d + self.radius > t)
            over = home & inside & (d + self.radius > t)
            node = np.concatenate([2 * node[inner] + 1, 2 * node[outer] + 2, 2 * node[over] + 2])
            row = np.concatenate([row[inner], row[outer], row[over]])
            home = np.concatenate([home[inner], home[outer], np.zeros(over.sum(), dtype=bool)])
        return row, node - ((1 << self.depth) - 1), home


class Links:
    """Local components over `points`: hooks each found pair's larger root to the smaller one."""

    def __init__(self, points: np.ndarray):
        self.points, self.root = points, np.arange(len(points))

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up

    def compare(self, rows: np.ndarray, home: np.ndarray, distance: int) -> None:
        """All pairs of `rows` and `home` (places in points), in blocks; pairs already joined are passed over."""
        step = max(1, LEAF_PAIRS // max(1, len(home)))
        for k in range(0, len(rows), step):
            part = rows[k:k + step]
            hit = np.bitwise_count(self.points[part][:, None] ^ self.points[home][None, :]) <= distance
            hit &= self.root[part][:, None] != self.root[home][None, :]
            if hit.any():
                a, b = np.nonzero(hit)
                self.add(part[a], home[b])

    def search(self, home: np.ndarray, own: np.ndarray, visit: np.ndarray, mask: np.uint64, radius: int,
               distance: int, seed: int = 0) -> None:
        """Links between `own` (query rows among `home`) or `visit` and `home`, dividing by spheres where it pays."""
        stack = [(home, own, visit, seed)]
        while stack:
            home, own, visit, seed = stack.pop()
            pairs = len(home) * (len(own) + len(visit))
            if not pairs:
                continue
            sphere = _sphere(self.points[home], mask, radius, seed) if pairs > LEAF_PAIRS and len(home) > 64 else None
            if sphere is None:
                self.compare(np.concatenate([own, visit]), home, distance)
                continue
            vantage, bound = sphere
            d_home, d_own, d_visit = (_apart(self.points[x], vantage, mask) for x in (home, own, visit))
            inside = d_home <= bound
            over = own[(d_own <= bound) & (d_own + radius > bound)]
            stack.append((home[inside], own[d_own <= bound], visit[d_visit - radius <= bound], 2 * seed + 1))
            stack.append((home[~inside], own[d_own > bound],
                          np.concatenate([visit[d_visit + radius > bound], over]), 2 * seed + 2))


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS,
          shard_points: int = SHARD_POINTS, shard_pairs: int = SHARD_PAIRS) -> DataFrame:
    """(u, v): links between different fingerprints that join exactly what all pairs within `distance` bits join.

    `prints` has one column fp of distinct longs.
    """
    spark, radius = prints.sparkSession, distance // blocks
    count = prints.count()
    depth = int(min(16, max(0, np.ceil(np.log2(max(1, count / shard_points))))))
    # Distinct fingerprints have evenly spread hashes, so the sample's size is that asked for, give or take its root.
    one_in = max(1, count // min(ROUTING_SAMPLE, 256 << depth))
    rows = prints.where(F.pmod(F.xxhash64("fp"), F.lit(one_in)) == 0 if depth else F.lit(False)).select("fp").toArrow()
    sample = np.sort(rows["fp"].to_numpy().astype(np.int64).view(np.uint64))
    masks = block_masks(blocks)
    trees = spark.sparkContext.broadcast([Tree(sample, m, radius, depth) for m in masks])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = batch["fp"].to_numpy(dtype=np.int64).view(np.uint64)
            for k, tree in enumerate(trees.value):
                row, shard, home = tree.routed(points)
                yield pd.DataFrame({"tree": np.int32(k), "shard": shard.astype(np.int32),
                                    "fp": points[row].view(np.int64), "home": home})

    routed = settled(prints.mapInPandas(route, "tree int, shard int, fp long, home boolean"), "simhash-shards")
    # At most blocks * 2^16 shards, whatever the input.
    home, rows = F.sum(F.col("home").cast("long")), F.count("*")
    side = F.lit(float(max(1, int(shard_pairs ** 0.5))))
    split = home * rows > shard_pairs
    sizes = routed.groupBy("tree", "shard").agg(
        F.when(split, F.ceil(home / side)).otherwise(1).cast("int").alias("homes"),
        F.when(split, F.ceil(rows / side)).otherwise(1).cast("int").alias("asking"))
    part = lambda name, seed: F.pmod(F.xxhash64("fp", F.lit(seed)), F.col(name)).cast("int")
    each = lambda name: F.sequence(F.lit(0), F.col(name) - 1)
    placed = routed.join(sizes, ["tree", "shard"])
    at_home = placed.where("home AND homes * asking > 1").withColumn("h", part("homes", 1)).withColumn("a", F.explode(each("asking")))
    asks = placed.withColumn("a", part("asking", 2)).withColumn("h", F.explode(each("homes")))
    # kind 0: a home point in a part of a grid; 1: one of a whole shard, which also asks; 2: a visitor, or a home point
    # that asks in a part of a grid.
    visits = F.when(F.col("home") & (F.col("homes") * F.col("asking") == 1), 1).otherwise(2)
    columns = ["tree", "shard", "h", "a", "fp"]
    dealt = at_home.select(*columns, F.lit(0).alias("kind")).union(asks.select(*columns, visits.alias("kind")))

    def look(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        points = np.unique(group["fp"].to_numpy(dtype=np.int64).view(np.uint64))
        found = Links(points)
        place = np.searchsorted(points, group["fp"].to_numpy(dtype=np.int64).view(np.uint64))
        kind = group["kind"].to_numpy()
        found.search(place[kind <= 1], place[kind == 1], place[kind == 2], masks[key[0]], radius, distance)
        moved = found.root != np.arange(len(points))
        return pd.DataFrame({"u": points[moved].view(np.int64), "v": points[found.root[moved]].view(np.int64)})

    return dealt.groupBy("tree", "shard", "h", "a").applyInPandas(look, "u long, v long")


def component_ids(prints: DataFrame, key: str, distance: int = DISTANCE) -> DataFrame:
    """(fp, root, component_id): each fingerprint's component and the smallest key in it. `prints` has key and fp."""
    classes = settled(prints.groupBy("fp").agg(F.min(key).alias("first")), "simhash-classes")
    stars = components(links(classes.select("fp"), distance)).select(
        F.col("u").alias("fp"), F.col("v").alias("root"))
    placed = classes.join(stars, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Only components of several fingerprints need another one's key. Few of them go to the rows, so that a component
    # with very many members stays spread out.
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members")).where("members > 1")
    found = attach(placed, least.select("root", "component_id"), ["root"], "left")
    return found.select("fp", "root", F.coalesce("component_id", "first").alias("component_id"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE) -> DataFrame:
    """One row per document: its key, fingerprint (16 hex digits) and component_id."""
    prints = settled(docs.select(F.col(key).alias("key"), fingerprint(F.col(text), shingle).alias("fp")), "simhash-prints")
    found = component_ids(prints, "key", distance)
    return prints.join(found, "fp").select(
        F.col("key").alias(key), hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def near_duplicates_removed(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                            distance: int = DISTANCE) -> DataFrame:
    """One row of each component with all its columns: the one with the smallest key, of repeated rows any one."""
    fp, row, kept = (spare(docs.columns, n) for n in ("fp", "row", "kept"))
    marked = settled(docs.select("*", fingerprint(F.col(text), shingle).alias(fp),
                                 F.monotonically_increasing_id().alias(row)), "simhash-rows")
    slim = marked.select(F.col(key).alias("key"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    found = component_ids(slim.select("key", "fp"), "key", distance).select("fp", "root")
    # The smallest (key, row) of each fingerprint first: a hot fingerprint shrinks before it meets its component.
    first = slim.groupBy("fp").agg(F.min(F.struct(F.col("key").isNull(), "key", "row")).alias("first"))
    classes = first.join(found, "fp").groupBy("root").agg(F.min("first").alias("first"))
    return marked.join(classes.select(F.col("first.row").alias(kept)), F.col(row) == F.col(kept), "left_semi") \
        .select(*docs.columns)
