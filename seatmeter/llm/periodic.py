"""Periodic runs of words, found with string synchronising sets (after Kempa and Kociumaka).

A run is a stretch of words with smallest period q, at least max(12, 2 * q) words long, that no neighbouring word extends
keeping the period. Periods below 6 are read off directly, word against word. For the others there is a scale
t = 2, 4, 8, ... for the periods from 3t to below 6t:

- Position i is in the scale's synchronising set if the smallest hash among the t-word windows at i ... i + t is that at
  i or at i + t. That depends on the 2t words from i alone, so equal stretches choose equal positions, and a stretch of
  3t - 1 words without any is highly periodic: its period is t / 3 at most. Windows inside such regions, which lower
  scales have found as runs, are left out of the choice; otherwise a region would choose all its positions.
- Two chosen positions with equal 2t words, 3t to below 6t apart, propose their distance as a period. How far it reaches
  to both sides comes from prefix hashes, by halving. A class has a bounded number of positions in 6t words, so the pairs
  of a scale are about as many as the words divided by t.
- A run without such a pair starts with a whole period inside a highly periodic region and ends with one inside the next,
  both of the same small period r, and the two meet or overlap by less than r words. Such neighbouring regions, found as
  runs before, give the omitted periods: all lengths that shift the one's phase to the other's.

The same stretch with two periods is reported with the smaller one, which is among those found. Words are compared by
number; longer stretches by two hashes modulo 2^31 - 1 together.

A text is worked on alone, next to others of about `GROUP` words in all; tasks hold numbers per word, and each different
word once. Nothing is shuffled.

Defined cases: a null, empty or blank text has no runs and an empty remainder. Repeated rows get equal results, null ids
are allowed, extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache
from itertools import count
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

LEAST = 12                   # words of a run
DIRECT = 5                   # periods read off word against word
GROUP = 1 << 18              # words worked on together; a longer text is a group of its own
CHUNK = 1 << 20              # bytes of a text divided into words at once
PRIME = np.uint64((1 << 31) - 1)
_BASES = (np.uint64(1_103_515_245), np.uint64(741_103_597))
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)

RUNS = ArrayType(StructType([StructField(n, LongType()) for n in ("start", "length", "period")]))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash from two, position by position."""
    out = a * np.uint64(0x9E3779B97F4A7C15)
    out += b
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def _ahead(values: np.ndarray, by: int, fill: np.uint64) -> np.ndarray:
    out = np.full(len(values), fill)
    out[:max(0, len(values) - by)] = values[by:]
    return out


@lru_cache(maxsize=2)
def _powers(bits: int) -> list[np.ndarray]:
    """The first 2^bits powers of each base."""
    out = []
    for base in _BASES:
        powers, step = np.ones(1, dtype=np.uint64), base
        for _ in range(bits):
            powers = np.concatenate([powers, powers * step % PRIME])
            step = step * step % PRIME
        out.append(powers.astype(np.uint32))
    return out


class Stretches:
    """Equality of stretches of a word sequence, by two prefix hashes."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.powers = _powers(max(16, self.n.bit_length()))
        self.sums = []
        for k, powers in enumerate(self.powers):
            value = mixed(words.astype(np.uint64), np.full(self.n, k + 1, dtype=np.uint64)) % PRIME
            value *= powers[:self.n]
            value %= PRIME
            self.sums.append(np.append(np.uint32(0), (np.cumsum(value, out=value) % PRIME).astype(np.uint32)))

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether `length` words at i are those at j; i is not behind j."""
        out = np.ones(len(i), dtype=bool)
        for sums, powers in zip(self.sums, self.powers):
            at_i = (sums[i + length] + (PRIME - sums[i])) % PRIME
            out &= at_i * powers[j - i] % PRIME == (sums[j + length] + (PRIME - sums[j])) % PRIME
        return out

    def reach(self, i: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the stretch around i whose words equal those `period` later; the end is included, and is
        that of the later words."""
        right, left = np.zeros(len(i), dtype=np.int64), np.zeros(len(i), dtype=np.int64)
        j = i + period
        for bit in range(self.n.bit_length() - 1, -1, -1):
            step = 1 << bit
            fits = np.flatnonzero(j + right + step <= self.n)
            fits = fits[self.equal(i[fits] + right[fits], j[fits] + right[fits], step)]
            right[fits] += step
            fits = np.flatnonzero(i - left - step >= 0)
            fits = fits[self.equal(i[fits] - left[fits] - step, j[fits] - left[fits] - step, step)]
            left[fits] += step
        return i - left, j + right - 1


def _unique(runs: np.ndarray) -> np.ndarray:
    """Rows (start, end, period), one for each stretch, with its smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), dtype=bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[first]


def _direct(words: np.ndarray) -> np.ndarray:
    """Runs of the smallest periods, and highly periodic regions too short for a run."""
    found = []
    for period in range(1, DIRECT + 1):
        equal = np.zeros(max(0, len(words) - period) + 2, dtype=np.int8)
        equal[1:-1] = words[:-period] == words[period:]
        change = np.flatnonzero(np.diff(equal))
        start, end = change[::2], change[1::2] + period - 1
        enough = end - start + 1 >= min(max(LEAST, 2 * period), max(3 * period, 4))
        found.append(np.stack([start[enough], end[enough], np.full(enough.sum(), period)], axis=1))
    return np.concatenate(found)


def _chosen(window: np.ndarray, scale: int, periodic: np.ndarray) -> np.ndarray:
    """The synchronising set: positions by the hashes of their `scale`-word windows, without the periodic ones."""
    window = np.where(periodic, _NEVER, window)
    least, size = window, 1
    while size < scale:
        least = np.minimum(least, _ahead(least, size, _NEVER))
        size *= 2
    least = np.minimum(least, _ahead(least, 1, _NEVER))
    return np.flatnonzero((least != _NEVER) & ((least == window) | (least == _ahead(window, scale, _NEVER))))


def _pairs(place: np.ndarray, context: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of chosen positions with equal contexts, 3 to below 6 scales apart."""
    order = np.argsort(context, kind="stable")
    place, context = place[order], context[order]
    at, step, found = np.arange(len(place)), 0, []
    while len(at):
        step += 1
        at = at[at + step < len(place)]
        distance = place[at + step] - place[at]
        near = (context[at + step] == context[at]) & (distance < 6 * scale)
        at, distance = at[near], distance[near]
        far = distance >= 3 * scale
        found.append((place[at[far]], distance[far]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (place[:0], place[:0])


def _covered(size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each position lies in one of the stretches start ... end."""
    return np.cumsum(np.bincount(start, minlength=size + 1) - np.bincount(end + 1, minlength=size + 1))[:size] > 0


def _across(runs: np.ndarray, stretches: Stretches) -> np.ndarray:
    """Runs that two neighbouring highly periodic regions of one small period make together."""
    runs = runs[runs[:, 1] - runs[:, 0] + 1 >= 9 * runs[:, 2]]
    runs = runs[np.lexsort((runs[:, 0], runs[:, 2]))]
    meet = np.flatnonzero((runs[1:, 2] == runs[:-1, 2]) & (runs[1:, 0] <= runs[:-1, 1] + 1)) if len(runs) else []
    found = []
    for (a, e, r), (b, f, _) in zip(runs[meet], runs[1:][meet]):
        turn = np.arange(r)
        same = turn[stretches.equal(a + turn, np.full(r, b), np.full(r, r))]
        if not len(same):
            continue
        phase = (b - a - int(same[0])) % r
        period = np.arange(8 * r + phase, min(e - a, f - b) + r + 1, r)
        start, end = np.maximum(a, b - period), np.minimum(e, f - period) + period
        found.append(np.stack([start, period], axis=1)[end - start + 1 >= 2 * period])
    at, period = np.concatenate([np.zeros((0, 2), dtype=np.int64), *found]).T
    return np.stack([*stretches.reach(at, period), period], axis=1)


def found_runs(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs. Texts begin at `starts`; one number of its own follows each of them."""
    runs = _direct(words)
    window = mixed(words.astype(np.uint64), np.full(len(words), 7, dtype=np.uint64))
    place, scale = np.arange(len(words)), 1            # the words still looked at, and the size of their windows
    stretches = None
    while True:
        window = mixed(window, _ahead(window, scale, np.uint64(0)))
        scale *= 2
        long = sizes >= 6 * scale
        if not long.any():
            break
        if sizes[long].sum() + long.sum() < 0.8 * len(place):
            alive = np.repeat(long, sizes + 1)
            window, place = window[alive], place[alive]
            starts, sizes = starts[long], sizes[long]
        # Positions among the words still looked at, for the regions found so far.
        region = runs[(3 * runs[:, 2] <= scale) & (runs[:, 1] - runs[:, 0] + 1 >= scale)]
        begin = np.searchsorted(place, region[:, 0])
        here = place[np.minimum(begin, len(place) - 1)] == region[:, 0]
        begin, region = begin[here], region[here]
        periodic = _covered(len(place), begin, begin + region[:, 1] - region[:, 0] - scale + 1)
        chosen = _chosen(window, scale, periodic)
        at, period = _pairs(chosen, mixed(window[chosen], _ahead(window, scale, np.uint64(0))[chosen]), scale)
        if not len(at):
            continue
        # Positions of one period whose contexts touch lie in one stretch: one of them is enough.
        order = np.lexsort((at, period))
        at, period = place[at[order]], period[order]
        first = np.ones(len(at), dtype=bool)
        first[1:] = (period[1:] != period[:-1]) | (at[1:] - at[:-1] > 2 * scale)
        at, period = at[first], period[first]
        stretches = stretches or Stretches(words)
        start, end = stretches.reach(at, period)
        enough = end - start + 1 >= 2 * period
        runs = _unique(np.concatenate([runs, np.stack([start, end, period], axis=1)[enough]]))
    if (runs[:, 1] - runs[:, 0] + 1 >= 9 * runs[:, 2]).any():
        runs = np.concatenate([runs, _across(_unique(runs), stretches or Stretches(words))])
    runs = _unique(runs)
    return runs[runs[:, 1] - runs[:, 0] + 1 >= np.maximum(LEAST, 2 * runs[:, 2])]


# ---- texts ------------------------------------------------------------------------------------------------------


def numbered(text: str | None, numbers: dict[bytes, int]) -> np.ndarray:
    """The words' numbers. `numbers` gives each new word the next one."""
    data, parts, at = (text or "").encode(), [], 0
    while at < len(data):
        end = at + CHUNK
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        words = data[at:end].split()
        parts.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def _results(texts: list[np.ndarray], names: list[bytes]) -> tuple[pa.Array, pa.Array]:
    """The runs and the remaining words of each text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    words = np.concatenate([np.append(t, len(names) + k) for k, t in enumerate(texts)])
    runs = found_runs(words, starts, sizes)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    owner = np.searchsorted(starts, runs[:, 0], side="right") - 1
    dropped = _covered(len(words), runs[:, 0] + runs[:, 2], runs[:, 1])
    has_run = np.bincount(owner, minlength=len(texts)) > 0
    left = []
    for k, text in enumerate(texts):
        if has_run[k]:
            text = text[~dropped[starts[k]:starts[k] + sizes[k]]]
        left.append(b" ".join(map(names.__getitem__, text.tolist())))
    fields = [runs[:, 0] - starts[owner], runs[:, 1] - runs[:, 0] + 1, runs[:, 2]]
    offsets = np.append(0, np.cumsum(np.bincount(owner, minlength=len(texts))))
    return (pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(f, pa.int64()) for f in fields], ["start", "length", "period"])),
        pa.array(left, pa.binary()).cast(pa.string()))


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, runs (start, length and period, by start, then period) and collapsed: the text's words, joined by
    one space, without those that a run contains after its first period."""
    schema = StructType([docs.schema[key], StructField("n_words", LongType()), StructField("runs", RUNS),
                         StructField("collapsed", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers: dict[bytes, int] = defaultdict(count().__next__)
            held: list[np.ndarray] = []
            total, first = 0, 0
            for k, value in enumerate(batch.column(1)):
                held.append(numbered(value.as_py(), numbers))
                total += len(held[-1]) + 1
                if total >= GROUP or k + 1 == batch.num_rows:
                    runs, left = _results(held, list(numbers))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, len(held)), pa.array([len(t) for t in held], pa.int64()), runs, left],
                        schema.names)
                    numbers, held, total, first = defaultdict(count().__next__), [], 0, k + 1

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)
