"""Exact top-k search by inner product over a bit-sliced index (after O'Neil and Quass, 1997, and Rinfret et al., 2001).

Components are quantised to integers, floor(256 x). A block of at most `BLOCK_ROWS` candidates, sorted by id, stores
each component as bit slices: bitmap b has the b-th bits of all its rows. A query's score is the sum of the slices, each
as often and as far shifted as the bits of the query's component say, taken by carry-save addition of whole bitmaps; for
negative components the complements are added. The sum is exact and is itself a list of slices. The best rows are then
picked from the most significant slice downward: a slice either narrows the candidates or admits them; rows still equal
after the last slice are ties, of which the smallest ids are taken. Only the picked rows' scores are ever written out.

The index is built once: each block's slices are written, a bit a slice and row. The queries are a stated set and meet all
rows, in blocks: queries are cut into groups of about `QUERY_ROWS`, and each pair of query group and block is one
task-sized unit of bounded size, to which the block's slices go. Blocks are dealt by a hash, so a vector that a third of
all rows share fills no unit. A unit returns k rows per query, which a ranked window reduces before the shuffle.

Defined cases: vectors that are null or hold a null or a non-finite component, and rows with a null id, take no part.
Vectors are compared with those of the same length only. Rows are told apart by position: a repeated row of a query is
a candidate for it. With fewer than k candidates all are returned. Extra columns are ignored. Vectors with a component
that exceeds `LARGEST` when quantised take no part; scores that do not fit a long are returned as the nearest long, in
which they are ties. An empty table gives an empty table.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seatmeter.llm.common import settled

BLOCK_ROWS = 1 << 14
QUERY_ROWS = 2048             # a candidate row is shuffled once for so many queries
LEAST_UNITS, LEAST_QUERIES = 16, 256
SCALE = 256
LARGEST = 2.0 ** 62           # of a quantised component
_LONG = (1 << 63) - 1


class SlicedBlock:
    """The bit slices of a block of integer vectors (rows by components)."""

    def __init__(self, vectors: np.ndarray):
        n, self.width = vectors.shape
        self.low = int(vectors.min()) if vectors.size else 0
        self.bits = (int(vectors.max()) - self.low).bit_length() if vectors.size else 0
        lifted = np.zeros((-(-n // 64) * 64, self.width), dtype=np.uint64)
        lifted[:n] = (vectors - self.low).astype(np.uint64)
        slices = [np.packbits(((lifted >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=0, bitorder="little").T
                  for b in range(self.bits)]
        plain = (np.ascontiguousarray(np.stack(slices)).view(np.uint64).reshape(self.bits * self.width, -1) if slices
                 else np.zeros((0, len(lifted) // 64), dtype=np.uint64))
        self._hold(plain, n)

    def _hold(self, plain: np.ndarray, n: int) -> None:
        self.slices = np.vstack([plain, ~plain])
        self.rows = np.zeros(plain.shape[1], dtype=np.uint64)
        self.rows.view(np.uint8)[:] = np.packbits(np.arange(64 * plain.shape[1]) < n, bitorder="little")

    def packed(self) -> bytes:
        return self.slices[:self.bits * self.width].tobytes()

    @classmethod
    def unpacked(cls, data: bytes, n: int, width: int, low: int, bits: int) -> SlicedBlock:
        block = cls.__new__(cls)
        block.width, block.low, block.bits = width, low, bits
        block._hold(np.frombuffer(data, dtype=np.uint64).reshape(bits * width, -(-n // 64)), n)
        return block

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """(slices of all scores plus a constant, the constant); the least significant slice first."""
        size, negative = np.abs(query), query < 0
        levels: dict[int, list[np.ndarray]] = defaultdict(list)
        for a in range(int(size.max()).bit_length() if len(query) else 0):
            chosen = np.flatnonzero((size >> a) & 1)
            first = chosen + negative[chosen] * (self.bits * self.width)
            for b in range(self.bits):
                levels[a + b].append(first + b * self.width)
        out, carries, level = [], [], 0
        while carries or level <= max(levels, default=-1):
            stack = carries
            if level in levels:
                stack = [self.slices[np.concatenate(levels[level])], *carries]
            carries = []
            column = np.concatenate(stack) if stack else np.zeros((0, len(self.rows)), dtype=np.uint64)
            while len(column) > 2:
                third = len(column) // 3
                a, b, c = column[:third], column[third:2 * third], column[2 * third:3 * third]
                odd = a ^ b
                carries.append((a & b) | (odd & c))
                column = np.concatenate([odd ^ c, column[3 * third:]])
            if len(column) == 2:
                carries.append((column[:1] & column[1:]))
                column = column[:1] ^ column[1:]
            out.append(column[0] if len(column) else np.zeros_like(self.rows))
            level += 1
        top = (1 << self.bits) - 1
        shift = sum(int(s) * (top + self.low if neg else -self.low) for s, neg in zip(size.tolist(), negative.tolist()))
        return out, shift

    def top(self, query: np.ndarray, k: int, without: int = -1) -> list[tuple[int, int]]:
        """(row, score) of the k best rows, ties to the earlier row; row `without` takes no part."""
        slices, shift = self.scores(query)
        open_ = self.rows.copy()
        if without >= 0:
            open_[without // 64] &= ~np.uint64(1 << (without % 64))
        sure = np.zeros_like(open_)
        have = 0
        for s in reversed(slices):
            one = open_ & s
            n = int(np.bitwise_count(one).sum())
            if have + n > k:
                open_ = one
            else:
                sure |= one
                have += n
                open_ = open_ & ~s
                if have == k:
                    break
        rows = _places(sure)
        if have < k:
            rows = np.concatenate([rows, _places(open_)[:k - have]])
        word, bit = rows // 64, (rows % 64).astype(np.uint64)
        values = [0] * len(rows)
        for level, s in enumerate(slices):
            for i, on in enumerate(((s[word] >> bit) & np.uint64(1)).tolist()):
                values[i] += on << level
        return sorted(((int(r), v - shift) for r, v in zip(rows, values)), key=lambda x: (-x[1], x[0]))


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_k(vectors: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding",
          scale: int = SCALE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, key, score): for each query row its k best other rows. `is_query` is a condition on the rows."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(finite).where(F.forall(
        vector, lambda x: F.abs(x.cast("double") * scale) <= LARGEST)).select(
        F.col(key).alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("x"))
    rows = settled(rows.withColumn("width", F.size("x")).withColumn("row", F.monotonically_increasing_id()), "topk-rows")
    count, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks = max(1, -(-count // block_rows))
    # Few blocks get more groups of fewer queries, so that all cores have a unit.
    more = min(-(-asking // LEAST_QUERIES), -(-LEAST_UNITS // blocks))
    groups = max(1, -(-asking // query_rows), more)
    kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.select("width", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"), "id", "row", "x")

    def built(there: pd.DataFrame) -> pd.DataFrame:
        there = there.sort_values(["id", "row"])
        block = SlicedBlock(np.array(there["x"].tolist(), dtype=np.int64).reshape(len(there), -1))
        return pd.DataFrame({
            "width": there["width"].iloc[:1], "block": there["block"].iloc[:1], "low": block.low, "bits": block.bits,
            "ids": [there["id"].to_numpy()], "places": [there["row"].to_numpy()], "slices": [block.packed()]})

    index = settled(dealt.groupBy("width", "block").applyInPandas(
        built, f"width int, block long, low long, bits int, ids array<{kind}>, places array<long>, slices binary"), "topk-index")
    candidates = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # The queries' columns have names of their own: both sides come from one table.
    queries = rows.where("asks").select(
        F.col("width").alias("q_width"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("q_block"),
        F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups)).cast("int").alias("q_part"),
        F.col("id").alias("q_id"), F.col("row").alias("q_row"), F.col("x").alias("q_x"))

    def search(there: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(there) and len(asked):
            width, low, bits, ids, rows_, slices = there.iloc[0][["width", "low", "bits", "ids", "places", "slices"]]
            places = {r: p for p, r in enumerate(rows_.tolist())}
            block = SlicedBlock.unpacked(slices, len(rows_), int(width), int(low), int(bits))
            for query, row, x in zip(asked["q_id"], asked["q_row"], asked["q_x"]):
                out += [(row, query, ids[r], max(-_LONG - 1, min(_LONG, s))) for r, s in block.top(
                    np.asarray(x, dtype=np.int64), k, places.get(row, -1))]
        return pd.DataFrame(out, columns=["row", "query_id", "id", "score"])

    found = candidates.groupBy("width", "block", "part").cogroup(queries.groupBy("q_width", "q_block", "q_part")).applyInPandas(
        search, f"row long, query_id {kind}, id {kind}, score long")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
