"""LM scoring: a class-based bigram model (Brown et al., 1992) with classes from the exchange algorithm.

    P(word, previous) = P(class of word | class of previous) * P(word | class of word)

Gathered from all training documents: the count of every word (a distributed table that grows with the corpus), the
counts of neighbouring states among the head, and the neighbours of every other word. The head is the `CLUSTERED` most
frequent words; a state is a head word, one of six shapes for all other words (last character full stop, comma or
neither; ASCII only or not), or the end of a document.

Every word goes through exchange clustering. The head starts: its state pairs, at most (CLUSTERED + 7)^2, go to the
driver, where one word after the other moves into the class that raises the training likelihood most. The other words
(the tail) lie in tasks, each with the counts of the states beside it, and start in classes of their shapes. In each of
`PASSES` passes every word of the tail moves to the class with the largest gain, the others of the tail staying where they
started; a class other than the shape's must gain log(classes) more, what it costs to name it. Words with little evidence
so stay with their shape: without that cost, words seen once or twice follow chance, and held-out texts score below the
base. After every pass the counts between head words and the tail's classes go to the driver, which exchanges the head
again. What a pass sends to the driver or to all tasks is bounded by the head, the classes and the dictionary, and not by
the vocabulary; a pass reads the tail once and shuffles nothing but sums.

The most frequent words (`DICTIONARY` at most, none longer than `LONGEST` bytes) with their counts and classes go to all
tasks (a bound of about 40 MB). Texts are then read as sequences of classes, in batches. For the words beyond the
dictionary, a batch asks once for each different one: its code goes to the bucket that holds the words of that range of
codes, and the count and the class come back. The batches with the answers are written once. One pass over them counts the
classes' transitions in the training documents, another one scores all documents.

Smoothing: transitions are Dirichlet-smoothed with the class shares. A word has (count + 0.5) / (tokens + 0.5 * words) of
its class; the class of a shape counts one word more, so one part is left for unseen words.

Defined cases: a null text is empty, and an empty text is its end token. Repeated rows count as often as they occur.
Null keys are allowed and count as training rows. Without training documents the base score is 0 and the model knows
only uniform transitions. Words beyond the dictionary are known by 60 bits of their hash. Extra columns are ignored. An
empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from copy import copy
from dataclasses import dataclass
from itertools import repeat
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from seatmeter.llm.common import remainder, settled

CLUSTERED = 2000
CLASSES = 64
ROUNDS = 8
PASSES = 4                   # over the tail
DICTIONARY = 200_000
LONGEST = 256                # bytes of a word of the dictionary
SHAPES = 6
PRIOR = 50.0                 # weight of the class shares in a transition
COUNTER = 500_000            # distinct words a counting task holds before it passes them on
BATCH = 2_000_000            # tokens of a batch
BUCKET_ITEMS = 2_000_000     # neighbours, or different words asked for, to a bucket
PAIR_BUCKETS = 16
MERGED_BYTES = 1 << 25       # neighbours a bucket takes in before it merges them
SMALL = 16                   # counts up to this are looked up when gains are computed
UNKNOWN = 255                # in a sequence of classes: a word beyond the dictionary


def tokens(text: bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased, without the end token."""
    return (text or b"").lower().split()


def shape(word: bytes) -> int:
    return (1 if word.endswith(b".") else 2 if word.endswith(b",") else 0) + (0 if word.isascii() else 3)


def code(word: bytes) -> int:
    """60 bits of the word's hash, then its shape."""
    return (xxhash.xxh64_intdigest(word, 42) >> 4) * 8 + shape(word)


def _shape_column(word: Column) -> Column:
    last = F.right(word, F.lit(1))
    return (F.when(last == ".", 1).when(last == ",", 2).otherwise(0)
            + F.when(F.octet_length(word) == F.length(word), 0).otherwise(3))


def _code_column(word: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(word), 4) * 8 + _shape_column(word)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all rows of `texts`, whose one column text is binary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def passed_on() -> pa.RecordBatch:
            word = pa.array(list(held), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([word, pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.update(tokens(text.as_py()))
                if len(held) > COUNTER:
                    yield passed_on()
                    held.clear()
        if held:
            yield passed_on()

    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """The most frequent words by rank, and the state of every token. The first `clustered` words are states."""

    def __init__(self, words: list[bytes], counts: np.ndarray, clustered: int):
        self.counts, self.clustered = counts, min(clustered, len(words))
        self.place = {w: k for k, w in enumerate(words)}
        self.shapes = np.fromiter(map(shape, words), dtype=np.int64, count=len(words))
        self.state = np.where(np.arange(len(words)) < self.clustered, np.arange(len(words)),
                              self.clustered + self.shapes)
        self.end = self.clustered + SHAPES
        self.states = self.end + 1

    def widened(self) -> Lexicon:
        """The same words, each a state of its own."""
        out = copy(self)
        out.clustered = len(self.counts)
        out.state, out.end = np.arange(out.clustered), out.clustered + SHAPES
        out.states = out.end + 1
        return out

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the lexicon, -1 for those that have none."""
        return np.fromiter(map(self.place.get, words, repeat(-1)), dtype=np.int64, count=len(words))

    def ids(self, words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
        """The place of each word. Words without a place are numbered after the end's, in the order in which `known`
        takes them in."""
        place, first = self.places(words), len(self.counts) + 1
        for k in np.flatnonzero(place < 0).tolist():
            place[k] = first + known.setdefault(words[k], len(known))
        return place


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchanged(first: np.ndarray, second: np.ndarray, n: np.ndarray, clustered: int, states: int,
              classes: int = CLASSES, rounds: int = ROUNDS, start: np.ndarray | None = None) -> np.ndarray:
    """The class of each state. Clustered words share the first `classes` classes, other states keep one of their own, or
    the one they have in `start`.

    One word after the other, most frequent first, moves to the class with the largest sum of
    N(c, d) log N(c, d) - 2 N(c) log N(c); the rounds end early when no word moves.
    """
    classes = max(1, min(classes, clustered))
    cls = np.concatenate([np.arange(clustered) % classes, classes + np.arange(states - clustered)])
    size = classes + states - clustered
    if start is not None:
        cls, size = start.copy(), int(start.max()) + 1
    between = np.bincount(cls[first] * size + cls[second], weights=n, minlength=size * size).reshape(size, size)
    total = between.sum(axis=0)
    by_first, by_second = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    out_ends = np.searchsorted(first[by_first], np.arange(clustered + 1))
    in_ends = np.searchsorted(second[by_second], np.arange(clustered + 1))
    for _ in range(rounds):
        moved = 0
        for w in range(clustered):
            after, before = by_first[out_ends[w]:out_ends[w + 1]], by_second[in_ends[w]:in_ends[w + 1]]
            own = n[after][second[after] == w].sum()
            after, before = after[second[after] != w], before[first[before] != w]
            right = np.bincount(cls[second[after]], weights=n[after], minlength=size)
            left = np.bincount(cls[first[before]], weights=n[before], minlength=size)
            old, count = cls[w], left.sum() + own
            between[old, :] -= right
            between[:, old] -= left
            between[old, old] -= own
            total[old] -= count
            part, diagonal = slice(0, classes), np.arange(classes)
            rows, columns = between[part], between[:, part]
            here = between[diagonal, diagonal]
            gain = ((_xlogx(rows + right) - _xlogx(rows)).sum(axis=1)
                    + (_xlogx(columns + left[:, None]) - _xlogx(columns)).sum(axis=0)
                    - _xlogx(here + right[part]) - _xlogx(here + left[part]) + _xlogx(here)
                    + _xlogx(here + right[part] + left[part] + own)
                    - 2 * (_xlogx(total[part] + count) - _xlogx(total[part])))
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            between[new, :] += right
            between[:, new] += left
            between[new, new] += own
            total[new] += count
            moved += new != old
            cls[w] = new
        if not moved:
            break
    return cls


def _dense_gains(between: np.ndarray, after: np.ndarray, before: np.ndarray, own: np.ndarray, old: np.ndarray) -> np.ndarray:
    """`gains`, each term by itself."""
    classes, word = len(between) - 1, np.arange(len(old))
    gain = np.zeros((len(old), classes))
    here = np.tile(np.diagonal(between)[:classes], (len(old), 1))
    here[word, old] -= after[word, old] + before[word, old] + own
    for mine, others, table in ((after, before, between), (before, after, between.T)):
        # Entry (w, d, x) changes table[c, d] into table[c, d] + x for each class c.
        at, d = np.nonzero(mine)
        x = mine[at, d]
        for k in range(0, len(old), 500):
            part = slice(*np.searchsorted(at, (k, k + 500)))
            w, e, n = at[part], d[part], x[part]
            if not len(w):
                continue
            rest = table[:classes, e].T.copy()
            same = np.flatnonzero(e == old[w])
            rest[np.arange(len(w)), old[w]] -= n
            rest[same] -= others[w[same], :classes]
            rest[same, e[same]] -= own[w[same]]
            change = _xlogx(rest + n[:, None]) - _xlogx(rest)
            starts = np.flatnonzero(np.diff(w, prepend=-1))
            gain[w[starts]] += np.add.reduceat(change, starts)
        gain -= _xlogx(here + mine[:, :classes]) - _xlogx(here)
    gain += _xlogx(here + after[:, :classes] + before[:, :classes] + own[:, None]) - _xlogx(here)
    count = before.sum(axis=1) + own
    total = np.tile(between.sum(axis=0)[:classes], (len(old), 1))
    total[word, old] -= count
    return gain - 2 * (_xlogx(total + count[:, None]) - _xlogx(total))


def gains(between: np.ndarray, after: np.ndarray, before: np.ndarray, own: np.ndarray, old: np.ndarray) -> np.ndarray:
    """What the training likelihood gains when a word, taken from its class `old`, joins each class but the end's: the
    terms of `exchanged` for many words at once, each beside the same `between`.

    Most words have a few neighbours of small counts, so a cell's change for all classes is looked up; what differs is
    the word's own class, and the cells that its removal changes. Words beside themselves are computed term by term.
    """
    classes = len(between) - 1
    gain = np.zeros((len(old), classes))
    alone = own > 0
    if alone.any():
        gain[alone] = _dense_gains(between, after[alone], before[alone], own[alone], old[alone])
    words = np.flatnonzero(~alone)
    if not len(words):
        return gain
    after, before, old = after[words], before[words], old[words]
    out, row = np.zeros((len(words), classes)), np.arange(len(words))
    diagonal = np.diagonal(between)[:classes]
    step = np.arange(1, SMALL + 1, dtype=np.float64)[:, None, None]

    def change(rest: np.ndarray, x: np.ndarray) -> np.ndarray:
        return _xlogx(rest + x) - _xlogx(rest)

    for mine, others, table in ((after, before, between), (before, after, between.T)):
        looked_up = change(table.T[None, :, :classes], step)        # by count, neighbour's class and class
        at, d = np.nonzero(mine)
        x = mine[at, d]
        small = (x <= SMALL) & (x == np.floor(x))
        for k in range(0, len(at), 20_000):
            part = slice(k, k + 20_000)
            w, e, n, low = at[part], d[part], x[part], small[part]
            cells = looked_up[np.where(low, n, 1).astype(np.int64) - 1, e]
            if not low.all():
                cells[~low] = change(table[:classes, e[~low]].T, n[~low, None])
            own_class = table[old[w], e]
            cells[np.arange(len(w)), old[w]] = change(own_class - n - np.where(e == old[w], others[w, old[w]], 0), n)
            # A neighbour of the word's own class: the word's removal changed the counts of that class with others.
            same = np.flatnonzero(e == old[w])
            hit, c = np.nonzero(others[w[same], :classes])
            cell = same[hit]
            elsewhere = c != old[w[cell]]
            cell, c = cell[elsewhere], c[elsewhere]
            cells[cell, c] = change(table[c, e[cell]] - others[w[cell], c], n[cell])
            starts = np.flatnonzero(np.diff(w, prepend=-1))
            out[w[starts]] += np.add.reduceat(cells, starts)
        inner = d < classes
        w, e, n = at[inner], d[inner], x[inner]
        here = diagonal[e] - np.where(e == old[w], after[w, e] + before[w, e], 0)
        out[w, e] -= change(here, n)
    both = after[:, :classes] + before[:, :classes]
    w, e = np.nonzero(both)
    here = diagonal[e] - np.where(e == old[w], both[w, e], 0)
    out[w, e] += change(here, both[w, e])
    count, total = before.sum(axis=1), between.sum(axis=0)[:classes]
    low = (count <= SMALL) & (count == np.floor(count)) & (count > 0)
    joined = change(total[None, :], step[:, 0])[np.where(low, count, 1).astype(np.int64) - 1]
    joined[~low] = change(total[None, :], count[~low, None])
    joined[row, old] = change(total[old] - count, count)
    gain[words] = out - 2 * joined
    return gain


# ---- the tail: words beyond the head, with the states beside them ------------------------------------------------


def _bucket(word: np.ndarray, buckets: int) -> np.ndarray:
    """Words beyond the dictionary by ranges of their codes, others by their places."""
    return np.where(word < 0, (-1 - word >> 31) * buckets >> 32, word % buckets)


def _pack(word: np.ndarray, size: np.ndarray, item: np.ndarray, n: np.ndarray) -> bytes:
    head = np.array([len(word), len(item)], dtype="<i8")
    return b"".join(x.tobytes() for x in (head, word.astype("<i8"), size.astype("<u4"), item.astype("<u2"), n.astype("<u4")))


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    words, items = np.frombuffer(data, dtype="<i8", count=2).tolist()
    out, at = [], 16
    for kind, count in (("<i8", words), ("<u4", words), ("<u2", items), ("<u4", items)):
        out.append(np.frombuffer(data, dtype=kind, count=count, offset=at))
        at += out[-1].nbytes
    return tuple(out)


def _grouped(word: np.ndarray, size: np.ndarray, item: np.ndarray, n: np.ndarray,
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different words, the number of items of each, the items, and how often, from rows that may repeat."""
    words, rank = np.unique(word, return_inverse=True)
    cell = np.repeat(rank, size) << 16 | item
    order = np.argsort(cell)
    cell, n = cell[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    cell, n = cell[first], np.add.reduceat(n, first) if len(first) else n
    return words, np.bincount(cell >> 16, minlength=len(words)), cell & 0xFFFF, n


def gathered(texts: DataFrame, lexicon, buckets: int) -> DataFrame:
    """(bucket, data). Below `buckets`: the words of the tail with 2 * state + side of the words beside them (side 0: after
    it) and how often; the state after the end's is the word itself, so a word has at most 4,016 of these. From there on,
    in `PAIR_BUCKETS` more: how often one state follows another, by first * states + second. `lexicon` is a broadcast."""

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value

        def dealt(held: list[np.ndarray], known: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
            codes = np.fromiter(map(code, known), dtype=np.int64, count=len(known))
            # By number: places, the end, the words beyond.
            states = np.concatenate([lex.state, [lex.end], lex.clustered + (codes & 7)])
            names = np.concatenate([np.arange(len(lex.state) + 1), -1 - codes])
            # Where one text meets the next, both are ends, which are not a pair.
            word = np.concatenate(held)
            state = states[word]
            meet = np.cumsum([len(h) for h in held])[2::3] - 1
            pair, n = np.unique(np.delete(state[:-1] * lex.states + state[1:], meet[:-1]), return_counts=True)
            order = np.argsort(pair % PAIR_BUCKETS, kind="stable")
            pair, n = pair[order], n[order]
            cuts = np.flatnonzero(np.diff(pair % PAIR_BUCKETS, prepend=-1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(buckets + pair[cuts] % PAIR_BUCKETS, pa.int32()), pa.array(
                    [np.stack([pair[a:b], n[a:b]]).astype("<i8").tobytes() for a, b in zip(cuts, np.append(cuts[1:], len(pair)))],
                    pa.binary())], ["bucket", "data"])
            tail = np.flatnonzero((state >= lex.clustered) & (state != lex.end))
            cells = []
            for side, k in enumerate((1, -1)):
                beside = np.where(word[tail + k] == word[tail], lex.states, state[tail + k])
                cells.append(word[tail] << 16 | 2 * beside + side)
            cell, n = np.unique(np.concatenate(cells), return_counts=True)
            row, item = cell >> 16, cell & 0xFFFF
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            yield _by_bucket(names[row[starts]], np.diff(np.append(starts, len(row))), item, n, buckets)

        held, n = [], 0
        known: dict[bytes, int] = {}
        edge = np.array([len(lex.counts)])
        for batch in batches:
            for text in batch.column(0):
                held += [edge, lex.ids(tokens(text.as_py()), known), edge]
                n += len(held[-2])
                if n > BATCH:
                    yield from dealt(held, known)
                    held, n = [], 0
                    known.clear()
        if held:
            yield from dealt(held, known)

    def merge(bucket: int, held: list[bytes]) -> bytes:
        if bucket >= buckets:
            pair, n = np.concatenate([np.frombuffer(data, "<i8").reshape(2, -1) for data in held], axis=1)
            pair, rank = np.unique(pair, return_inverse=True)
            return np.stack([pair, np.bincount(rank, weights=n).astype(np.int64)]).astype("<i8").tobytes()
        parts = [_unpack(data) for data in held]
        return _pack(*_grouped(*(np.concatenate(x) for x in zip(*parts))))

    rows = texts.mapInArrow(sides, "bucket int, data binary")
    return settled(_merged(rows, merge, buckets + PAIR_BUCKETS), "brown-tail", compression="zstd")


def _by_bucket(word: np.ndarray, size: np.ndarray, item: np.ndarray, n: np.ndarray, buckets: int) -> pa.RecordBatch:
    bucket = _bucket(word, buckets)
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(size)
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    numbers, data = [], []
    for a, b in zip(cuts, np.append(cuts[1:], len(order))):
        chosen = order[a:b]
        each = size[chosen]
        at = np.repeat(ends[chosen] - each, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        numbers.append(int(bucket[chosen[0]]))
        data.append(_pack(word[chosen], each, item[at], n[at]))
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])


def _merged(rows: DataFrame, merge, buckets: int) -> DataFrame:
    """One row per bucket, from all of its rows. They are merged whenever `MERGED_BYTES` have come, so a task holds the
    bucket's words and their items once, however many batches have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, more = None, [], 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([merge(now, held)], pa.binary())],
                                              ["bucket", "data"])

        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != now and held:
                    yield done()
                    held, more = [], 0
                now = bucket
                held.append(data.as_py())
                more += len(held[-1])
                if len(held) > 1 and more > MERGED_BYTES + len(held[0]):
                    held, more = [merge(now, held)], 0
        if held:
            yield done()

    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket int, data binary")


@dataclass
class Base:
    """What the words of the tail move beside: the classes of the states and the counts between classes, with all of the
    tail in the classes of its shapes."""
    between: np.ndarray
    state_class: np.ndarray     # by state
    shapes: np.ndarray          # of the dictionary's words
    clustered: int
    classes: int                # learned ones

    def moved(self, data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, tuple]]:
        """(words, their counts, their classes, (word, state, side, n) of the items), some thousand words at a time."""
        word, size, item, n = _unpack(data)
        ends, all_ = np.cumsum(size), len(self.between)
        myself = len(self.state_class)
        for first in range(0, len(word), 8192):
            part = slice(first, first + 8192)
            some = slice(int(ends[first] - size[first]), int(ends[part][-1]))
            row = np.repeat(np.arange(len(word[part])), size[part])
            state, side, times = item[some] >> 1, item[some] & 1, n[some].astype(np.float64)
            beside = state != myself
            cell = (row * 2 + side)[beside] * all_ + self.state_class[state[beside]]
            counts = np.bincount(cell, weights=times[beside], minlength=len(word[part]) * 2 * all_).reshape(-1, 2, all_)
            own = np.bincount(row[~beside & (side == 0)], weights=times[~beside & (side == 0)], minlength=len(word[part]))
            home = self.classes + np.where(word[part] >= 0, self.shapes[np.maximum(word[part], 0)], -1 - word[part] & 7)
            gain = gains(self.between, counts[:, 0], counts[:, 1], own, home)
            at = np.arange(len(home))
            stay = gain[at, home]
            gain[:, self.classes:] = -np.inf
            gain[:, :self.classes] -= math.log(self.classes)
            best = gain.argmax(axis=1)
            cls = np.where(gain[at, best] > stay + 1e-9, best, home)
            yield word[part], counts[:, 0].sum(axis=1) + own, cls, (row, state, side, times)


def tail_pass(tail: DataFrame, base) -> DataFrame:
    """(kind, a, n). Kind 0: place of a word of the dictionary, class. Kind 1: pair of states, count, where the states are
    the head, the classes of the tail and the end. `base` is a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = base.value
        every = b.classes + SHAPES
        states = b.clustered + every + 1
        # A head word is a state of its own, a word of the tail that of its shape, the end the last.
        other = np.concatenate([np.arange(b.clustered), b.clustered + b.classes + np.arange(SHAPES), [states - 1]])
        held = np.zeros((2, every, states))
        places, found = [], []
        for batch in batches:
            for data in batch.column("data"):
                for word, _, cls, (row, state, side, n) in b.moved(data.as_py()):
                    mine = cls[row]
                    to = np.where(state == len(b.state_class), b.clustered + mine, np.append(other, 0)[state])
                    # A pair within the tail counts once, from its first word.
                    used = (side == 0) | (to < b.clustered) | (to == states - 1)
                    held += np.bincount(((side.astype(np.int64) * every + mine) * states + to)[used], weights=n[used],
                                        minlength=held.size).reshape(held.shape)
                    places.append(word[word >= 0])
                    found.append(cls[word >= 0])
        side, mine, to = np.nonzero(held)
        pair = np.where(side == 0, (b.clustered + mine) * states + to, to * states + b.clustered + mine)
        place, cls = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (places, found))
        yield pa.RecordBatch.from_pydict({
            "kind": pa.array(np.repeat([0, 1], [len(place), len(pair)]).astype(np.int32)),
            "a": pa.array(np.concatenate([place, pair]).astype(np.int64)),
            "n": pa.array(np.concatenate([cls, held[side, mine, to]]).astype(np.int64))})

    return tail.mapInArrow(run, "kind int, a long, n long").groupBy("kind", "a").agg(F.sum("n").alias("n"))


def beyond_words(tail: DataFrame, base) -> DataFrame:
    """(bucket, data): codes, counts and classes of the words beyond the dictionary, by code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data")):
                parts = [(-1 - w[w < 0], n[w < 0], c[w < 0]) for w, n, c, _ in base.value.moved(data.as_py())]
                if parts:
                    codes, n, cls = (np.concatenate(x) for x in zip(*parts))
                    order = np.argsort(codes)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([bucket], pa.int32()), pa.array([_answers(codes[order], n[order], cls[order])], pa.binary())],
                        ["bucket", "data"])

    return settled(tail.mapInArrow(run, "bucket int, data binary"), "brown-classes", compression="zstd")


def _answers(codes: np.ndarray, n: np.ndarray, cls: np.ndarray) -> bytes:
    return b"".join((codes.astype("<i8").tobytes(), n.astype("<i8").tobytes(), cls.astype("<u1").tobytes()))


def _read_answers(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = len(data) // 17
    return (np.frombuffer(data, "<i8", size), np.frombuffer(data, "<i8", size, 8 * size),
            np.frombuffer(data, "<u1", size, 16 * size))


@dataclass
class Clustering:
    lexicon: Lexicon
    classes: int                # learned ones
    cls: np.ndarray             # class by place in the lexicon
    known: DataFrame            # (bucket, data) of the words beyond
    buckets: int
    words: np.ndarray           # different words by class
    totals: np.ndarray          # tokens by class, the end's last
    documents: int


def clustered_words(texts: DataFrame, counts: DataFrame, clustered: int, classes: int, dictionary: int) -> Clustering:
    spark = texts.sparkSession
    documents = texts.count()
    lexicon = Lexicon(*frequent(counts, dictionary), clustered)
    shared = spark.sparkContext.broadcast(lexicon)
    c = lexicon.clustered
    beside_tail = 2 * ((counts.agg(F.sum("n")).first()[0] or 0) - float(lexicon.counts[:c].sum()))
    buckets = 1 + int(beside_tail) // BUCKET_ITEMS
    tail = gathered(texts, shared, buckets)
    # At most (clustered + 7)^2 pairs of numbers.
    pairs = [np.frombuffer(r["data"], "<i8").reshape(2, -1) for r in tail.where(F.col("bucket") >= buckets).select("data").collect()]
    pair, n = np.concatenate([np.zeros((2, 0), dtype=np.int64), *pairs], axis=1)
    order = np.argsort(pair)
    n = n[order].astype(np.float64)
    first, second = (x.astype(np.int32) for x in np.divmod(pair[order], lexicon.states))
    del pairs, pair, order
    tail = tail.where(F.col("bucket") < buckets)
    head = exchanged(first, second, n, c, lexicon.states, classes)[:c]
    classes = max(1, min(classes, c))
    end = classes + SHAPES
    states = c + end + 1
    inner = ((first < c) | (first == lexicon.end)) & ((second < c) | (second == lexicon.end))
    head_pairs = [*(np.where(x[inner] == lexicon.end, states - 1, x[inner]).astype(np.int64) for x in (first, second)), n[inner]]
    cls = np.append(classes + lexicon.shapes, end)
    shapes = np.append(lexicon.shapes, 0)
    for _ in range(PASSES):
        state_class = np.concatenate([head, np.arange(classes, end + 1)])
        between = np.bincount(state_class[first] * (end + 1) + state_class[second], weights=n,
                              minlength=(end + 1) ** 2).reshape(end + 1, end + 1)
        base = spark.sparkContext.broadcast(Base(between, state_class, shapes, c, classes))
        # At most one row of two numbers per word of the dictionary, and per pair of a head word and a class.
        got = tail_pass(tail, base).toArrow()
        kind, a, times = (got[x].to_numpy() for x in ("kind", "a", "n"))
        cls[a[kind == 0]] = times[kind == 0]
        one, two = np.divmod(a[kind == 1], states)
        one, two, times = (np.concatenate(x) for x in zip(head_pairs, (one, two, times[kind == 1].astype(np.float64))))
        order = np.argsort(one * states + two)
        start = np.concatenate([head, np.arange(end + 1)])
        head = exchanged(one[order], two[order], times[order], c, states, classes, 1, start)[:c]
    cls[:c] = head
    known = beyond_words(tail, base)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = np.zeros(end, dtype=np.int64), np.zeros(end, dtype=np.int64)
        for batch in batches:
            for data in batch.column("data"):
                _, times, own = _read_answers(data.as_py())
                words += np.bincount(own, minlength=end)
                total += np.bincount(own, weights=times, minlength=end).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"class": pa.array(np.arange(end)), "words": pa.array(words), "total": pa.array(total)})

    words, totals = np.bincount(cls[:-1], minlength=end).astype(np.float64), np.zeros(end + 1)
    totals[:end] = np.bincount(cls[:-1], weights=lexicon.counts, minlength=end)
    totals[end] = documents
    for r in known.mapInArrow(sums, "class long, words long, total long").groupBy("class").agg(
            F.sum("words").alias("words"), F.sum("total").alias("total")).collect():
        words[r["class"]] += r["words"]
        totals[r["class"]] += r["total"]
    words[classes:] += 1
    return Clustering(lexicon, classes, cls[:-1], known, buckets, words, totals, documents)


# ---- batches: documents as sequences of classes ------------------------------------------------------------------


@dataclass
class Reader:
    """What turns texts into classes and sums. It goes to all tasks."""
    lexicon: Lexicon
    cls: np.ndarray
    emission: np.ndarray        # log10 P(word | class) by place
    base: np.ndarray            # log10 of the base share by place


@dataclass
class Batch:
    """Documents of one batch: tokens, whether they train, sums over the dictionary's words, the classes of all tokens
    (`UNKNOWN` for words beyond) and, for these, the number of the word among the batch's different ones."""
    tokens: np.ndarray
    train: np.ndarray
    known: np.ndarray
    base: np.ndarray
    emission: np.ndarray
    classes: np.ndarray
    rare: np.ndarray
    n: np.ndarray               # answers, by number
    own: np.ndarray

    _KINDS = (("tokens", "<u4"), ("train", "<u1"), ("known", "<u4"), ("base", "<f8"), ("emission", "<f8"),
              ("classes", "<u1"), ("rare", "<u4"), ("n", "<i8"), ("own", "<u1"))

    def packed(self) -> bytes:
        parts = [getattr(self, name).astype(kind) for name, kind in self._KINDS]
        return np.array([len(p) for p in parts], dtype="<i8").tobytes() + b"".join(p.tobytes() for p in parts)

    @classmethod
    def unpacked(cls, data: bytes) -> Batch:
        sizes, at, parts = np.frombuffer(data, "<i8", len(cls._KINDS)).tolist(), 8 * len(cls._KINDS), []
        for (_, kind), size in zip(cls._KINDS, sizes):
            parts.append(np.frombuffer(data, kind, size, at))
            at += parts[-1].nbytes
        return cls(*parts)

    def sequence(self, chosen: np.ndarray, end: int) -> np.ndarray:
        """The classes of the chosen documents' tokens, an end before, between and behind them."""
        classes = self.classes.copy()
        classes[classes == UNKNOWN] = self.own[self.rare]
        classes = classes[np.repeat(chosen, self.tokens)].astype(np.int64)
        stops = np.cumsum(self.tokens[chosen].astype(np.int64))
        return np.concatenate([[end], np.insert(classes, stops, end)])


_PARTS = "bucket int, batch long, data binary, keys {}"


def resolved(docs: DataFrame, clustering: Clustering, reader) -> DataFrame:
    """(batch, data, keys): `docs` (key, train, text) in batches with the answers for words beyond the dictionary.
    `reader` is a broadcast."""
    buckets, classes = clustering.buckets, clustering.classes
    keys = ArrayType(docs.schema["key"].dataType)
    schema = StructType([*docs.sparkSession.createDataFrame([], "bucket int, batch long, data binary").schema.fields,
                         StructField("keys", keys)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, number = reader.value, TaskContext.get().partitionId() << 32
        known: dict[bytes, int] = {}

        def asked(part: pa.RecordBatch, held: list[np.ndarray], known: dict[bytes, int], number: int) -> pa.RecordBatch:
            ids = np.concatenate(held)
            sizes = np.array([len(h) for h in held])
            owner = np.repeat(np.arange(len(held)), sizes)
            found = ids < len(r.cls)
            # Different words that share a code are one.
            codes, rank = np.unique(np.fromiter(map(code, known), dtype=np.int64, count=len(known)), return_inverse=True)
            rare = rank[ids[~found] - len(r.cls) - 1]
            by = lambda w: np.bincount(owner[found], weights=w, minlength=len(held))
            sequence = np.full(len(ids), UNKNOWN)
            sequence[found] = r.cls[ids[found]]
            batch = Batch(sizes, part.column("train").to_numpy(zero_copy_only=False), by(np.ones(found.sum())),
                          by(r.base[ids[found]]), by(r.emission[ids[found]]), sequence, rare, np.zeros(0), np.zeros(0))
            bucket = _bucket(-1 - codes, buckets)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            data = [codes[a:b].tobytes() for a, b in zip(cuts, np.append(cuts[1:], len(codes)))]
            own = pa.ListArray.from_arrays(pa.array([0, len(held)] + [len(held)] * len(data), pa.int32()), part.column("key"))
            return pa.RecordBatch.from_arrays(
                [pa.array([-1, *bucket[cuts].tolist()], pa.int32()), pa.array([number] * (len(data) + 1), pa.int64()),
                 pa.array([batch.packed(), *data], pa.binary()), own], schema.names)

        for batch in batches:
            held, n, first = [], 0, 0
            for k, text in enumerate(batch.column("text")):
                held.append(r.lexicon.ids(tokens(text.as_py()), known))
                n += len(held[-1])
                if n >= BATCH or k + 1 == batch.num_rows:
                    yield asked(batch.slice(first, len(held)), held, known, number)
                    known.clear()
                    held, n, first, number = [], 0, k + 1, number + 1

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table = None, None
        for batch in batches:
            out = []
            for bucket, number, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "batch", "data"))):
                if bucket != now:
                    now, table = bucket, _read_answers(b"")
                if number < 0:                         # the bucket's words come before all questions
                    table = _read_answers(data)
                    continue
                codes = np.frombuffer(data, "<i8")
                at = np.minimum(np.searchsorted(table[0], codes), max(0, len(table[0]) - 1))
                hit = table[0][at] == codes if len(table[0]) else np.zeros(len(codes), dtype=bool)
                n, own = np.zeros(len(codes), dtype=np.int64), classes + (codes & 7)
                n[hit], own[hit] = table[1][at[hit]], table[2][at[hit]]
                out.append((bucket, number, n.astype("<i8").tobytes() + own.astype("<u1").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*out), (pa.int32(), pa.int64(), pa.binary()))], ["bucket", "batch", "data"])

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, own = None, None, []

        def done() -> pa.RecordBatch:
            batch = Batch.unpacked(held.column("data")[0].as_py())
            sizes = [len(d) // 9 for d in own]
            batch.n = np.concatenate([np.frombuffer(d, "<i8", s) for d, s in zip(own, sizes)] + [np.zeros(0, np.int64)])
            batch.own = np.concatenate([np.frombuffer(d, "<u1", s, 8 * s) for d, s in zip(own, sizes)] + [np.zeros(0, np.uint8)])
            return pa.RecordBatch.from_arrays([held.column("bucket"), held.column("batch"), pa.array([batch.packed()], pa.binary()),
                                               held.column("keys")], schema.names)

        for batch in batches:
            number = batch.column("batch").to_pylist()
            for k, bucket in enumerate(batch.column("bucket").to_pylist()):
                if number[k] != now and held is not None:
                    yield done()
                    own = []
                now = number[k]
                if bucket < 0:
                    held = batch.slice(k, 1)
                else:
                    own.append(batch.column("data")[k].as_py())
        if held is not None:
            yield done()

    parts = settled(docs.mapInArrow(read, schema), "brown-questions", compression="zstd")
    small = "bucket int, batch long, data binary"
    questions = parts.where("bucket >= 0").select("bucket", "batch", "data")
    words = clustering.known.select("bucket", F.lit(-1).cast("long").alias("batch"), "data")
    answers = (questions.unionByName(words).repartition(buckets, "bucket").sortWithinPartitions("bucket", "batch")
               .mapInArrow(answer, small))
    whole = parts.where("bucket < 0").unionByName(answers.withColumn("keys", F.lit(None).cast(keys)))
    # The answers of a batch follow it by bucket, which is the order of its codes.
    return settled(whole.repartition("batch").sortWithinPartitions("batch", "bucket").mapInArrow(put_together, schema),
                   "brown-batches", compression="zstd")


def transitions(batches: DataFrame, end: int) -> np.ndarray:
    """How often one class follows another in the documents that train."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((end + 1) ** 2, dtype=np.int64)
        for row in rows:
            for data in row.column("data"):
                batch = Batch.unpacked(data.as_py())
                way = batch.sequence(batch.train > 0, end)
                held += np.bincount(way[:-1] * (end + 1) + way[1:], minlength=len(held))
        yield pa.RecordBatch.from_pydict({"pair": pa.array(np.arange(len(held))), "n": pa.array(held)})

    # Classes squared, in each task as in the result.
    counted = batches.select("data").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((end + 1) ** 2)
    out[counted["pair"].to_numpy()] = counted["n"].to_numpy()
    return out.reshape(end + 1, end + 1)


@dataclass
class Model:
    lexicon: Lexicon            # every word a state
    classes: np.ndarray         # class by state
    transition: np.ndarray      # log10 P(class | class)
    emission: np.ndarray        # log10 P(word | class) by place in the lexicon
    base: np.ndarray            # log10 of the base share by place in the lexicon
    loss: np.ndarray            # log10 of the denominator of each class
    shape_loss: np.ndarray      # log10 of the denominator of each shape's class
    base_loss: float            # log10 of the base denominator
    end_base: float
    end_known: int
    train_tokens: int
    beyond: DataFrame           # (word, n, class) of the words beyond the lexicon
    batches: DataFrame          # the documents, read

    def scores(self, batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, base score, score) of each document."""
        everything = np.ones(len(batch.tokens), dtype=bool)
        way = batch.sequence(everything, len(self.loss))
        steps = batch.tokens.astype(np.int64) + 1
        score = batch.emission + np.add.reduceat(self.transition[way[:-1], way[1:]], np.cumsum(steps) - steps)
        owner = np.repeat(np.arange(len(steps)), batch.tokens)[batch.classes == UNKNOWN]
        n, own = batch.n[batch.rare], batch.own[batch.rare]
        by = lambda w: np.bincount(owner, weights=w, minlength=len(steps))
        half = np.log10(n + 0.5)
        return (batch.known + by(n > 0).astype(np.int64) + self.end_known,
                batch.base + by(half - self.base_loss) + self.end_base, score + by(half - self.loss[own]))


def frequent(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """The words above a count, and their counts, by falling count. The count is the lowest one, in steps of an eighth
    of a doubling, that at most `most` words reach: words of equal count are in or out together, and nothing is sorted
    but those words."""
    step = F.floor(F.log2("n") * 8).cast("int")
    short = counts.where(F.octet_length("word") <= LONGEST)
    sizes = sorted(short.groupBy(step.alias("step")).count().collect(), reverse=True)    # 512 rows at most
    reached, lowest = 0, None
    for r in sizes:
        reached += r["count"]
        if reached > most:
            break
        lowest = r["step"]
    chosen = short.where(step >= lowest if lowest is not None else F.lit(False)).select(
        F.col("word").cast("binary").alias("word"), "n").toArrow()
    pairs = sorted(zip(chosen["n"].to_pylist(), chosen["word"].to_pylist()), key=lambda x: (-x[0], x[1]))
    return [w for _, w in pairs], np.array([n for n, _ in pairs], dtype=np.float64)


def learned(texts: DataFrame, counts: DataFrame, clustered: int = CLUSTERED, classes: int = CLASSES,
            dictionary: int = DICTIONARY, docs: DataFrame | None = None) -> Model:
    """`texts`: the training texts (binary), `counts`: their word counts; `docs`: all documents (key, train, text), if
    there are more."""
    spark = texts.sparkSession
    found = clustered_words(texts, counts, clustered, classes, dictionary)
    lexicon, end = found.lexicon, found.classes + SHAPES
    loss = np.log10(np.maximum(found.totals[:-1] + 0.5 * found.words, 0.5))
    emission = np.log10(lexicon.counts + 0.5) - loss[found.cls]
    distinct, occurrences = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    distinct += found.documents > 0
    train = int(occurrences) + found.documents
    base_loss = math.log10(train + 0.5 * (distinct + 1))
    base = np.log10(lexicon.counts + 0.5) - base_loss
    reader = spark.sparkContext.broadcast(Reader(lexicon, found.cls, emission, base))
    if docs is None:
        docs = texts.select(F.lit(0).alias("key"), F.lit(True).alias("train"), "text")
    batches = resolved(docs, found, reader)
    between = transitions(batches, end)
    total = between.sum(axis=0)
    share = (total + 0.5) / (total.sum() + 0.5 * len(between))
    transition = np.log10((between + PRIOR * share) / (between.sum(axis=1, keepdims=True) + PRIOR))

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for data in part.column("data"):
                codes, _, cls = _read_answers(data.as_py())
                yield pa.RecordBatch.from_pydict({"code": pa.array(codes), "class": pa.array(cls.astype(np.int64))})

    beyond = counts.withColumn("code", _code_column(F.col("word"))).join(
        found.known.mapInArrow(rows, "code long, class long"), "code").select("word", "n", "class")
    return Model(lexicon.widened(), np.concatenate([found.cls, np.arange(found.classes, end + 1)]), transition, emission, base,
                 loss, loss[found.classes:], base_loss, math.log10(found.documents + 0.5) - base_loss,
                 int(found.documents > 0), train, beyond, batches)


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", clustered: int = CLUSTERED,
              classes: int = CLASSES, dictionary: int = DICTIONARY) -> DataFrame:
    """Per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held_out = F.coalesce(remainder(key, 5) == 1, F.lit(False))
    rows = docs.select(F.col(key).alias("key"), (~held_out).alias("train"), F.col(text).cast("binary").alias("text"))
    texts = rows.where("train").select("text")
    model = learned(texts, settled(word_counts(texts), "brown-counts"), clustered, classes, dictionary, rows)
    batches, train_tokens = model.batches, model.train_tokens
    model.beyond = model.batches = None
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([docs.select(F.col(key)).schema[0], StructField("held_out", BooleanType()),
                         StructField("n_tokens", LongType()), StructField("n_known", LongType()),
                         StructField("train_tokens", LongType()), StructField("base_score", DoubleType()),
                         StructField("score", DoubleType())])

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for data, keys in zip(part.column("data"), part.column("keys")):
                batch = Batch.unpacked(data.as_py())
                known, base, got = shared.value.scores(batch)
                yield pa.RecordBatch.from_arrays(
                    [keys.values, pa.array(batch.train == 0), pa.array(batch.tokens.astype(np.int64) + 1),
                     pa.array(known.astype(np.int64)), pa.array(np.full(len(known), train_tokens, dtype=np.int64)),
                     pa.array(base), pa.array(got)], schema.names)

    return batches.select("data", "keys").mapInArrow(score, schema)
