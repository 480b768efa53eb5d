"""Long repeated byte strings across all documents, by merging sorted suffixes of shards (after Holt and McMillan, 2014).

A byte goes if a `length`-byte string that covers it also starts anywhere else. Shards of a few megabytes each sort their
own suffixes; what follows a suffix orders its row, what precedes it is the row's symbol, as in a Burrows-Wheeler
transform. The shards' rows meet in buckets, where their interleave is refined: rows with an equal prefix form a block,
blocks divide by deeper prefixes and the symbols before them, and rows that stand alone leave. Blocks that are left at the
full length are the repeated intervals. Suffixes are sorted once, in their shard, and only merged afterwards.

One refinement per byte, as the method has it, would be `length` rounds over every byte. Three things make it two rounds:

- Only suffixes at anchors take part. The anchor of the string at i is the position, among i ... i + reach - 1, whose gram
  has the smallest hash (the first of equal ones). Equal strings have equal anchors, so a repeat is never missed. The
  strings of one anchor are consecutive: a row stands for about half of `reach` of them.
- Rows are ordered by the hash of their first length - reach bytes, which all strings of the anchor share. Any fixed
  order makes the same blocks.
- The first round compares the anchors' prefixes, and within a block all the bytes that a row's strings cover, before and
  after the anchor. Rows equal there are repeats as a whole. Where a block's rows differ (texts that agree on a part
  only, about the edges of copies), the second round takes the strings of one row of each kind singly. A string has one
  anchor at one distance, so strings of different blocks are never equal, and the two rounds are exact.

Hashes have 64 bits, and rows are equal by two of them over different blocks of the bytes.

Rows that are equal within a shard travel once, so a passage that a third of all documents holds reaches its bucket once
per shard. Rows are dealt by all that they hold, so a passage with other bytes about it in every text is spread out, too.
The number of buckets follows the bytes. Texts are written once, with row numbers, and never shuffled while
the found spans fit a broadcast (checked); beyond that they are joined by row number.

Defined cases: a null text is empty; texts below `length` bytes keep all. Every occurrence is removed, the first too.
Repeated rows remove each other. Null ids are allowed and extra columns are ignored. What is kept is binary, as a span
may divide a character. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from seatmeter.llm.common import settled

LENGTH = 400
UNIT = 1 << 22               # bytes of a shard; a longer text is a shard of its own
PIECE = 1 << 17              # positions hashed at once
BUCKET_BYTES = 1 << 24       # bytes of text to a bucket: about 350,000 rows
MERGED_ROWS = 2_000_000      # rows a bucket takes in before it merges them
BROADCAST_SPANS = 1_000_000  # 16 MB; more spans are joined by a shuffle

_PARTS = "bucket int, batch long, data binary"
_FOUND = "uid long, start long, stop long, open boolean"
_REPEATS, _OPEN, _KINDS, _DIRECTORY = -1, -2, -3, -4      # what a row says instead of a bucket
_TWICE = np.uint32(1 << 31)
_ROW = np.dtype([("follows", "<u8"), ("all", "<u8"), ("place", "<u4")])
_POSITION = np.uint64((1 << 24) - 1)


class Shape:
    """The sizes that follow from the length: anchors, their grams, and the blocks that are hashed."""

    def __init__(self, length: int):
        self.length = length
        self.reach = max(1, length * 6 // 25)
        self.block = 1 << ((length - self.reach).bit_length() - 1)
        self.gram = min(16, self.block, 1 << max(0, (length // 16).bit_length() - 1))
        self.spread = -(-(length + self.reach - 1) // self.block)        # blocks that cover all strings of an anchor
        self.beyond = 2 * length + self.reach + self.gram + self.block


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * np.uint64(0x9E3779B97F4A7C15)
    out += b
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


_BYTES = mixed(np.arange(256, dtype=np.uint64), np.full(256, 0x2545F4914F6CDD1D, dtype=np.uint64))


def _hashes(data: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams and of the blocks that start at each position."""
    out, size = _BYTES[data], 1
    grams = out
    while size < shape.block:
        out = mixed(out[:-size], out[size:])
        size *= 2
        if size == shape.gram:
            grams = out
    return grams, out


def _anchors(grams: np.ndarray, reach: int) -> np.ndarray:
    """For each position the first of the smallest grams among the `reach` from there on."""
    least = grams & ~_POSITION | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while 2 * size <= reach:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if rest := reach - size:
        least = np.minimum(least[:-rest], least[rest:])
    return (least & _POSITION).astype(np.int64)


def _pieces(data: np.ndarray, shape: Shape) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first position, positions, gram hashes, block hashes) of consecutive parts of the data."""
    data = np.concatenate([data, np.zeros(shape.beyond, dtype=np.uint8)])
    for first in range(0, len(data) - shape.beyond, PIECE):
        n = min(PIECE, len(data) - shape.beyond - first)
        yield first, n, *_hashes(data[first:first + n + shape.beyond], shape)


def anchored(data: np.ndarray, valid: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """(start, strings, hash of what follows the anchor, hash of all): the rows of the anchors. Strings start where
    `valid` says so."""
    made = []
    for first, n, grams, blocks in _pieces(data, shape):
        here = np.zeros(n + 2, dtype=bool)
        here[1:-1] = valid[first:first + n]
        anchor = _anchors(grams, shape.reach)[:n]
        change = np.ones(n + 1, dtype=bool)
        change[1:-1] = anchor[1:] != anchor[:-1]
        start = np.flatnonzero(here[1:-1] & (change[:-1] | ~here[:-2]))
        last = np.flatnonzero(here[1:-1] & (change[1:] | ~here[2:]))
        anchor = anchor[start]
        follows = mixed(blocks[anchor], blocks[anchor + shape.length - shape.reach - shape.block])
        size = last - start + shape.length
        every = ((anchor - start) << 32 | size).astype(np.uint64)
        for k in range(shape.spread):
            every = mixed(every, blocks[start + (size - shape.block) * k // max(1, shape.spread - 1)])
        made.append((start + first, last - start + 1, follows, every))
    return tuple(np.concatenate(x) for x in zip(*made))


def single(data: np.ndarray, wanted: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """As `anchored`, a row for each wanted string."""
    made = []
    for first, n, _, blocks in _pieces(data, shape):
        at = np.flatnonzero(wanted[first:first + n])
        tail = shape.length - shape.block
        ends = mixed(blocks[at], blocks[at + tail])
        made.append((at + first, np.ones(len(at), dtype=np.int64), ends, mixed(blocks[at + tail // 2], blocks[at])))
    return tuple(np.concatenate(x) for x in zip(*made))


# ---- shards: sorted rows, and a directory of their places -------------------------------------------------------


def _packed(*columns: np.ndarray) -> bytes:
    return zlib.compress(b"".join(np.diff(c.astype(np.int64), prepend=0).tobytes() for c in columns), 1)


def _unpacked(data: bytes, columns: int) -> list[np.ndarray]:
    return list(np.cumsum(np.frombuffer(zlib.decompress(data), dtype=np.int64).reshape(columns, -1), axis=1))


def _range(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _equal_rows(follows: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, block, kind): rows sorted, and numbers of equal prefixes and of equal rows in that order."""
    order = np.lexsort((every, follows))
    new_block = np.append(True, follows[order[1:]] != follows[order[:-1]])[:len(order)]
    new_kind = new_block | np.append(True, every[order[1:]] != every[order[:-1]])[:len(order)]
    return order, np.cumsum(new_block) - 1, np.cumsum(new_kind) - 1


def shard(batch: int, uid: np.ndarray, lo: np.ndarray, n: np.ndarray, follows: np.ndarray, every: np.ndarray,
          buckets: int) -> pa.RecordBatch:
    """A shard's rows by bucket, equal ones once, and its directory."""
    order, _, kind = _equal_rows(follows, every)
    copies = np.bincount(kind)
    again = np.zeros(len(order), dtype=np.int64)
    again[order] = copies[kind] > 1
    chosen = order[np.append(True, kind[1:] != kind[:-1])[:len(order)]]
    rows = np.zeros(len(chosen), dtype=_ROW)
    rows["follows"], rows["all"] = follows[chosen], every[chosen]
    rows["place"] = chosen.astype(np.uint32) | np.where(again[chosen] > 0, _TWICE, np.uint32(0))
    bucket = _range(mixed(rows["follows"], rows["all"]), buckets)
    by = np.argsort(bucket, kind="stable")
    rows, bucket = rows[by], bucket[by]
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[:len(bucket)])
    data = [rows[a:b].tobytes() for a, b in zip(cuts, np.append(cuts[1:], len(rows)))]
    return pa.RecordBatch.from_arrays(
        [pa.array([_DIRECTORY - batch % buckets, *bucket[cuts].tolist()], pa.int32()),
         pa.array([batch] * (len(data) + 1), pa.int64()), pa.array([_packed(uid, lo, n, again), *data], pa.binary())],
        ["bucket", "batch", "data"])


def _by_bucket(rows: DataFrame, buckets: int, merger) -> DataFrame:
    """Each bucket's (batch, data) go to a `merger` of its own, which gives (bucket, batch, data) as it takes them in, and
    the rest at its end. Negative buckets pass as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for got in batches:
            number = got.column("bucket").to_numpy()
            if (number < 0).any():
                yield got.filter(pa.array(number < 0))
            for k in np.flatnonzero(number >= 0).tolist():
                if number[k] != now:
                    if held:
                        yield _rows(held.rest())
                    now, held = int(number[k]), merger(int(number[k]))
                out = held.take(got.column("batch")[k].as_py(), got.column("data")[k].as_py())
                if out:
                    yield _rows(out)
        if held:
            yield _rows(held.rest())

    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _PARTS)


class Interleave:
    """The merge of the shards' rows of one bucket. It holds different rows, however many shards send the same one."""

    def __init__(self, bucket: int):
        self.bucket, self.held, self.batches = bucket, [], []
        self.told = 0                                  # rows at the beginning of what is held that were merged before

    def take(self, batch: int, data: bytes) -> list[tuple[int, int, bytes]]:
        self.held.append(np.frombuffer(data, dtype=_ROW))
        self.batches.append(np.full(len(self.held[-1]), batch, dtype="<i8"))
        return self._merged() if sum(map(len, self.held)) - self.told > MERGED_ROWS + self.told else []

    def _merged(self) -> list[tuple[int, int, bytes]]:
        """Rows found to be repeats. One of each kind stays, a repeat among them marked as such."""
        rows, batch = np.concatenate(self.held), np.concatenate(self.batches)
        order, _, kind = _equal_rows(rows["follows"], rows["all"])
        rows, batch = rows[order], batch[order]
        twice = rows["place"] & _TWICE > 0
        copies = np.bincount(kind, 1 + twice)
        repeat = (copies > 1)[kind]
        # A row that stayed and was marked has been told.
        fresh = repeat & ~((order < self.told) & twice)
        first = np.append(True, kind[1:] != kind[:-1])[:len(kind)]
        place = rows["place"] & ~_TWICE
        shard, owner = np.unique(batch, return_inverse=True)
        out = [(_REPEATS, int(shard[owner[c[a]]]), place[c[a:b]].tobytes()) for a, b, c in _cut(owner, fresh)]
        kept = rows[first].copy()
        kept["place"] = place[first] | np.where(repeat[first], _TWICE, np.uint32(0))
        self.held, self.batches, self.told = [kept], [batch[first]], len(kept)
        return out

    def rest(self) -> list[tuple[int, int, bytes]]:
        out = self._merged()
        kinds, batch = self.held[0], self.batches[0]
        place = (kinds["place"] & ~_TWICE).astype("<u4")
        return [*out, (_KINDS, self.bucket, kinds["follows"].tobytes() + batch.tobytes() + place.tobytes())]


class Answers:
    """Which prefixes of one bucket have several kinds of rows: of all buckets together, each asking once."""

    def __init__(self, bucket: int):
        self.bucket, self.held = bucket, []

    def take(self, sender: int, data: bytes) -> list[tuple[int, int, bytes]]:
        self.held.append((sender, data))
        return []

    def rest(self) -> list[tuple[int, int, bytes]]:
        sizes = [len(data) // 9 for _, data in self.held]
        follows = np.concatenate([np.frombuffer(data, "<u8", n) for (_, data), n in zip(self.held, sizes)])
        more = np.concatenate([np.frombuffer(data, "u1", n, 8 * n) for (_, data), n in zip(self.held, sizes)])
        _, block = np.unique(follows, return_inverse=True)
        several = (np.bincount(block, 1 + more) > 1)[block]
        return [(self.bucket, sender, part.tobytes())
                for (sender, _), part in zip(self.held, np.split(several, np.cumsum(sizes)[:-1]))]


def _rows(out: Iterable[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*out)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary()))],
                                      ["bucket", "batch", "data"])


def interleaved(parts: DataFrame, buckets: int, name: str) -> DataFrame:
    """(bucket, batch, data): which rows of each shard are repeats (`_REPEATS`), one row of each kind by bucket
    (`_KINDS`, with the bucket as batch), and the directories (other negative buckets)."""

    return settled(_by_bucket(parts, buckets, Interleave), name, compression="zstd")


def _cut(owner: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, stop, places) of the wanted places of each owner."""
    chosen = np.flatnonzero(wanted)
    chosen = chosen[np.argsort(owner[chosen], kind="stable")]
    cuts = np.flatnonzero(np.diff(owner[chosen], prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(chosen))):
        yield a, b, chosen


def _kinds(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data) // 20
    return (np.frombuffer(data, "<u8", n), np.frombuffer(data, "<i8", n, 8 * n), np.frombuffer(data, "<u4", n, 16 * n))


def differing(merged: DataFrame, buckets: int) -> DataFrame:
    """(bucket, batch, data): by shard, the rows (one of each kind) of blocks that hold several kinds (`_OPEN`).

    Rows of one prefix lie in many buckets, so a prefix that very many texts share, each with other bytes about it, is
    never gathered: each bucket tells the prefix's own bucket once whether it has one kind or more, and hears whether
    there are several.
    """
    kinds = merged.where(F.col("bucket") == _KINDS)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            for sender, data in zip(got.column("batch").to_pylist(), got.column("data")):
                follows, n = np.unique(_kinds(data.as_py())[0], return_counts=True)
                bucket = _range(follows, buckets)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                yield _rows((int(bucket[a]), sender, follows[a:b].tobytes() + (n[a:b] > 1).tobytes())
                            for a, b in zip(cuts, np.append(cuts[1:], len(follows))))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, flags = None, None, []

        def done() -> pa.RecordBatch:
            follows, batch, place = _kinds(held)
            several = np.frombuffer(b"".join(flags), dtype=bool)
            chosen = several[np.searchsorted(np.unique(follows), follows)]
            shard, owner = np.unique(batch, return_inverse=True)
            return _rows((_OPEN, int(shard[owner[c[a]]]), place[c[a:b]].tobytes()) for a, b, c in _cut(owner, chosen))

        for got in batches:
            for bucket, sender, data in zip(*(got.column(c).to_pylist() for c in ("bucket", "batch", "data"))):
                if sender != now and held is not None:
                    yield done()
                    held, flags = None, []
                now = sender
                if bucket < 0:
                    held = data
                else:
                    flags.append(data)                 # by bucket, which is the order of the prefixes
        if held is not None:
            yield done()

    answers = _by_bucket(kinds.mapInArrow(ask, _PARTS), buckets, Answers)
    return (kinds.unionByName(answers).repartition("batch").sortWithinPartitions("batch", "bucket")
            .mapInArrow(opened, _PARTS))


def placed(found: DataFrame, length: int) -> DataFrame:
    """(uid, start, stop, open): repeated spans of bytes, and where open, the starts of strings still to be compared."""

    def spans(directory: bytes, repeats: list[bytes], differing: list[bytes]) -> Iterator[pa.RecordBatch]:
        uid, lo, n, again = _unpacked(directory, 4)
        again = again > 0
        again[np.frombuffer(b"".join(repeats), dtype="<u4")] = True
        still = np.sort(np.frombuffer(b"".join(differing), dtype="<u4"))
        whose, start, stop = uid[again], lo[again], (lo + n - 1 + length)[again]
        begins = np.append(True, (whose[1:] != whose[:-1]) | (start[1:] > stop[:-1]))[:len(whose)]
        cuts = np.flatnonzero(begins)
        last = np.append(cuts[1:], len(whose))[:len(cuts)] - 1
        columns = [np.concatenate(x) for x in (
            (whose[cuts], uid[still]), (start[cuts], lo[still]), (stop[last], (lo + n)[still]))]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in columns), pa.array(np.arange(len(columns[0])) >= len(cuts))],
            ["uid", "start", "stop", "open"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [])
        for got in batches:
            for bucket, batch, data in zip(*(got.column(c).to_pylist() for c in ("bucket", "batch", "data"))):
                if batch != now and held[0]:
                    yield from spans(held[0][0], *held[1:])
                    held = ([], [], [])
                now = batch
                held[1 if bucket == _REPEATS else 2 if bucket == _OPEN else 0].append(data)
        if held[0]:
            yield from spans(held[0][0], *held[1:])

    return found.where(F.col("bucket") != _KINDS).repartition("batch").sortWithinPartitions("batch").mapInArrow(run, _FOUND)


# ---- documents --------------------------------------------------------------------------------------------------


def _batch_numbers() -> Iterator[int]:
    task = TaskContext.get().partitionId()
    number = 0
    while True:
        yield task << 32 | number
        number += 1


def _anchored_shards(docs: DataFrame, shape: Shape, buckets: int) -> DataFrame:
    length = shape.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _batch_numbers()

        def finished(uids: list[int], texts: list[bytes]) -> pa.RecordBatch:
            sizes = np.array([len(t) for t in texts])
            ends = np.cumsum(sizes)
            valid = np.ones(ends[-1], dtype=bool)
            for end in ends.tolist():
                valid[end - length + 1:end] = False
            lo, n, follows, every = anchored(np.frombuffer(b"".join(texts), dtype=np.uint8), valid, shape)
            owner = np.searchsorted(ends, lo, side="right")
            return shard(next(numbers), np.array(uids)[owner], lo - (ends - sizes)[owner], n, follows, every, buckets)

        for batch in batches:
            uids, texts, total = [], [], 0
            for uid, data in zip(batch.column("uid").to_pylist(), batch.column("data")):
                if len(data := data.as_py()) >= length:
                    uids.append(uid)
                    texts.append(data)
                    total += len(data)
                if total >= UNIT:
                    yield finished(uids, texts)
                    uids, texts, total = [], [], 0
            if uids:
                yield finished(uids, texts)

    return docs.select("uid", "data").where(F.octet_length("data") >= length).mapInArrow(run, _PARTS)


def _single_shards(docs: DataFrame, shape: Shape, buckets: int) -> DataFrame:
    """Rows for the strings that start in the `ranges` of each document."""
    length = shape.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _batch_numbers()

        def finished(uids: list[int], firsts: list[int], counts: list[int], texts: list[bytes]) -> pa.RecordBatch:
            sizes = np.array([len(t) for t in texts])
            ends = np.cumsum(sizes)
            begins = ends - sizes
            edge = np.zeros(ends[-1] + 1, dtype=np.int64)
            edge[begins] += 1
            edge[begins + np.array(counts)] -= 1
            lo, n, follows, every = single(np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum(edge)[:-1] > 0, shape)
            owner = np.searchsorted(ends, lo, side="right")
            return shard(next(numbers), np.array(uids)[owner], lo - begins[owner] + np.array(firsts)[owner], n, follows,
                         every, buckets)

        for batch in batches:
            held: tuple[list, ...] = ([], [], [], [])
            total = 0
            for uid, data, ranges in zip(*(batch.column(c) for c in ("uid", "data", "ranges"))):
                uid, data, joined = uid.as_py(), data.as_py(), []
                for start, stop in ((r["start"], r["stop"]) for r in ranges.as_py()):
                    if joined and start <= joined[-1][1]:
                        joined[-1][1] = max(stop, joined[-1][1])
                    else:
                        joined.append([start, stop])
                for start, stop in joined:
                    for values, value in zip(held, (uid, start, stop - start, data[start:stop - 1 + length])):
                        values.append(value)
                    total += stop - start + length
                if total >= UNIT:
                    yield finished(*held)
                    held, total = ([], [], [], []), 0
            if held[0]:
                yield finished(*held)

    return docs.select("uid", "data", "ranges").where("ranges IS NOT NULL").mapInArrow(run, _PARTS)


def _with_ranges(docs: DataFrame, spans: DataFrame, name: str, how: str) -> DataFrame:
    """Each document with its ranges (start, stop) in order."""
    ranges = settled(spans.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("ranges")), name)
    if (ranges.agg(F.sum(F.size("ranges"))).first()[0] or 0) <= BROADCAST_SPANS:
        ranges = F.broadcast(ranges)
    return docs.join(ranges, "uid", how)


def repeats_removed(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """key, n_bytes, spans (start and stop of the removed bytes, in order, none touching) and kept (the others)."""
    shape = Shape(length)
    schema = StructType([docs.schema[key], StructField("n_bytes", LongType()), StructField("spans", ArrayType(
        StructType([StructField("start", LongType()), StructField("stop", LongType())]))), StructField("kept", BinaryType())])
    docs = settled(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("key"),
                               F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("data")), "repeats-texts",
                   compression="zstd")
    buckets = 1 + (docs.agg(F.sum(F.octet_length("data").cast("long"))).first()[0] or 0) // BUCKET_BYTES
    merged = interleaved(_anchored_shards(docs, shape, buckets), buckets, "repeats-anchors")
    found = settled(placed(merged.unionByName(differing(merged, buckets)), length), "repeats-anchored")
    opened = found.where("open").drop("open")
    strings = opened.agg(F.sum(F.col("stop") - F.col("start"))).first()[0] or 0
    spans = found.where("NOT open").drop("open")
    if strings:
        singles = _single_shards(_with_ranges(docs, opened, "repeats-open", "inner"), shape, 1 + strings * 50 // BUCKET_BYTES)
        spans = spans.union(placed(interleaved(singles, 1 + strings * 50 // BUCKET_BYTES, "repeats-strings"), length)
                            .where("NOT open").drop("open"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, kept, first, total = [], [], [], 0, 0
            for k, (data, ranges) in enumerate(zip(batch.column("data"), batch.column("ranges"))):
                data, joined = data.as_py(), []
                for r in ranges.as_py() or ():
                    if joined and r["start"] <= joined[-1]["stop"]:
                        joined[-1]["stop"] = max(r["stop"], joined[-1]["stop"])
                    else:
                        joined.append(r)
                at = [0, *(r["stop"] for r in joined)]
                until = [*(r["start"] for r in joined), len(data)]
                sizes.append(len(data))
                gone.append(joined)
                kept.append(b"".join(data[a:b] for a, b in zip(at, until)) if joined else data)
                total += len(data)
                if total >= UNIT or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key").slice(first, len(sizes)), pa.array(sizes, pa.int64()),
                         pa.array(gone, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                         pa.array(kept, pa.binary())], schema.names)
                    sizes, gone, kept, first, total = [], [], [], k + 1, 0

    return _with_ranges(docs, spans, "repeats-spans", "left").select("key", "data", "ranges").mapInArrow(run, schema)
