"""Language ID by multilingual mixture inference (after Lui, Lau and Baldwin, 2014).

Learning counts hashed letter trigrams per language over all training documents: one histogram of `BINS` bins per
language and task, then a sum. The model has languages times `BINS` numbers (256 KB a language), whatever the corpus.

Inference sees a document as words, each written in one of several languages. A word's likelihood in a language is the
product over its trigrams; expectation-maximisation estimates the languages' proportions, until none changes by more than
`TOLERANCE`. A word counts as often as it occurs and is looked at once. Starting from all languages, the one with the smallest proportion is left out as long as that lowers the Bayesian information criterion, which
leaves the language set. The document's language is the one with the largest proportion, and the score is that
proportion. All of a text is used, read in parts, so that a task holds its different words and not all of them. Scoring
is one narrow pass without a shuffle.

Defined cases: a null text, or one without any letter, is `und` with score 0 and no languages. Training rows with a
null language or text are passed over. Without any training row everything is `und`. Ties go to the smaller language
name. Repeated rows get equal results. Extra columns pass through `identified`, null ids are allowed (they count as
held in). An empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from typing import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from seatmeter.llm.common import remainder

BINS = 1 << 16
SMOOTH = 0.5
TOLERANCE = 1e-7             # of a proportion, where expectation-maximisation ends
STEPS = 10_000               # guards against a fault only
PART = 1 << 20               # characters of a text read at once
CELLS = 2_000_000            # trigrams times languages looked up at once
HISTOGRAMS = 128             # languages a learning task counts before it passes on what it has
UNKNOWN = "und"

RESULT = StructType([StructField("lang", StringType()), StructField("score", DoubleType()),
                     StructField("languages", ArrayType(StringType())), StructField("shares", ArrayType(DoubleType()))])

_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def _parts(text: str) -> Iterator[str]:
    """The text, cut at blanks."""
    at = 0
    while at < len(text):
        end = at + PART
        while end < len(text) and text[end] not in " \n\t":
            end += 1
        yield text[at:end]
        at = end


def _words(text: str) -> list[bytes]:
    """Lower-cased words; ASCII characters other than letters divide them."""
    return text.lower().encode().translate(_LETTERS).split()


def _trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed trigrams of all words, each with a space before and after, and where each word's trigrams begin."""
    data = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8)
    letter = np.flatnonzero(data[1:-1] != 32)          # a trigram belongs to the word of its middle byte
    a, b, c = (data[letter + k].astype(np.uint32) for k in range(3))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return ((a * 40503 + b) * 40503 + c) * np.uint32(2654435761) >> np.uint32(16), np.cumsum(sizes) - sizes


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray           # log-probability by trigram and language

    def word_logs(self, words: list[bytes]) -> np.ndarray:
        grams, starts = _trigrams(words)
        return np.add.reduceat(self.table[grams], starts, axis=0)


def _mixture(likelihood: np.ndarray, times: np.ndarray, owner: np.ndarray, starts: np.ndarray, shares: np.ndarray,
             ) -> tuple[np.ndarray, np.ndarray]:
    """(shares, log-likelihood) per document, from the given shares on. Documents whose shares rest leave the rounds."""
    out, open_ = shares.copy(), np.arange(len(starts))
    l, t, o, s, p = likelihood, times, owner, starts, shares
    n = np.add.reduceat(t, s)[:, None]
    for _ in range(STEPS):
        mixed = l * p[o]
        mixed *= (t / mixed.sum(axis=1))[:, None]
        new = np.add.reduceat(mixed, s, axis=0) / n
        moving = np.abs(new - p).max(axis=1) > TOLERANCE
        p = new
        out[open_] = p
        if not moving.any():
            break
        if moving.sum() < 0.7 * len(moving):
            rows = moving[o]
            sizes = np.diff(s, append=len(o))[moving]
            open_, p, n, l, t = open_[moving], p[moving], n[moving], l[rows], t[rows]
            o, s = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    total = times * np.log((likelihood * out[owner]).sum(axis=1))
    return out, np.add.reduceat(total, starts)


def proportions(model: Model, documents: list[Iterable[bytes]]) -> np.ndarray:
    """Language shares of each document (its words, or a count of them; one at least), zero outside the chosen set."""
    held = [d if isinstance(d, Counter) else Counter(d) for d in documents]
    counts = np.array([len(d) for d in held])
    times = np.fromiter((n for d in held for n in d.values()), dtype=np.float64, count=int(counts.sum()))
    logs = model.word_logs([w for d in held for w in d]).astype(np.float64)
    # Far worse languages keep a tiny likelihood, so that a set without the best one still has a value.
    likelihood = np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -60.0))
    owner, starts = np.repeat(np.arange(len(held)), counts), np.cumsum(counts) - counts
    words = np.add.reduceat(times, starts)
    k = len(model.languages)
    shares, value = _mixture(likelihood, times, owner, starts, np.full((len(held), k), 1.0 / k))
    active = np.full(len(held), k)
    open_ = np.flatnonzero(active > 1)
    while len(open_):
        rows = np.concatenate([np.arange(starts[i], starts[i] + counts[i]) for i in open_])
        fewer = shares[open_].copy()
        smallest = np.where(fewer > 0, fewer, np.inf).argmin(axis=1)
        fewer[np.arange(len(open_)), smallest] = 0
        fewer /= fewer.sum(axis=1, keepdims=True)
        own = np.repeat(np.arange(len(open_)), counts[open_])
        fewer, got = _mixture(likelihood[rows], times[rows], own, np.cumsum(counts[open_]) - counts[open_], fewer)
        better = 2 * (value[open_] - got) <= np.log(np.maximum(words[open_], 2))
        chosen = open_[better]
        shares[chosen], value[chosen], active[chosen] = fewer[better], got[better], active[chosen] - 1
        # A share that has died out counts as left out, at no cost in likelihood.
        open_ = chosen[(shares[chosen] > 0).sum(axis=1) > 1]
    return shares


def learned(docs: DataFrame, text: str = "text", language: str = "lang") -> Model:
    """The model from all rows given; language and text must not be null to count."""
    rows = docs.select(F.col(language).cast("string").alias("lang"), F.col(text).alias("text")).dropna()

    def histograms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}

        def flushed() -> Iterator[pd.DataFrame]:
            for lang, count in counts.items():
                gram = np.flatnonzero(count)
                yield pd.DataFrame({"lang": lang, "gram": gram.astype(np.int32), "n": count[gram]})
            counts.clear()

        for batch in batches:
            for lang, text_ in zip(batch["lang"], batch["text"]):
                for part in _parts(text_):
                    if not (words := _words(part)):
                        continue
                    if lang not in counts:
                        if len(counts) == HISTOGRAMS:
                            yield from flushed()
                        counts[lang] = np.zeros(BINS, dtype=np.int64)
                    counts[lang] += np.bincount(_trigrams(words)[0], minlength=BINS)
        yield from flushed()

    sums = rows.mapInPandas(histograms, "lang string, gram int, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))
    # One row per language: its bins in order. The number of languages bounds what reaches the driver.
    dense = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("gram", "n"))).alias("bins")).select(
        "lang", F.transform("bins", lambda x: x["gram"]).alias("gram"), F.transform("bins", lambda x: x["n"]).alias("n"))
    got = dense.toPandas().sort_values("lang")
    table = np.zeros((len(got), BINS))
    for row, (gram, n) in enumerate(zip(got["gram"], got["n"])):
        table[row, np.asarray(gram)] = n
    table = np.log((table + SMOOTH) / (table.sum(axis=1, keepdims=True) + SMOOTH * BINS))
    return Model(got["lang"].tolist(), np.ascontiguousarray(table.T, dtype=np.float32))


def language(text: Column, model: Model) -> Column:
    """Struct of lang, score, and the chosen languages with their shares, largest first."""

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import regex

        letter = regex.compile(r"\p{L}")
        limit = max(1, CELLS // max(1, len(model.languages)))
        for texts in batches:
            out: list[tuple] = [(UNKNOWN, 0.0, [], [])] * len(texts)
            waiting: list[tuple[int, Counter[bytes]]] = []
            size = 0

            def settle() -> None:
                for (place, _), shares in zip(waiting, proportions(model, [w for _, w in waiting])):
                    order = np.argsort(-shares, kind="stable")[:int((shares > 0).sum())]
                    out[place] = (model.languages[order[0]], min(1.0, float(shares[order[0]])),
                                  [model.languages[i] for i in order], [float(shares[i]) for i in order])
                waiting.clear()

            for place, text_ in enumerate(texts):
                if text_ is None or not model.languages or not letter.search(text_):
                    continue
                waiting.append((place, Counter()))
                for part in _parts(text_):
                    waiting[-1][1].update(_words(part))
                size += min(len(text_), 8 * len(waiting[-1][1]))
                if size >= limit:
                    settle()
                    size = 0
            if waiting:
                settle()
            yield pd.DataFrame(out, columns=RESULT.names)

    return run(text)


def identified(docs: DataFrame, model: Model, text: str = "text", into: str = "language") -> DataFrame:
    return docs.withColumn(into, language(F.col(text), model))


def language_report(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per document: key, held_out, lang_pred, score, n_languages. Learns from the rows that are not held out."""
    held_out = F.coalesce(remainder(key, 4) == 2, F.lit(False))
    model = learned(docs.where(~held_out), text, lang)
    found = docs.select(key, held_out.alias("held_out"), language(F.col(text), model).alias("found"))
    return found.select(key, "held_out", F.col("found.lang").alias("lang_pred"), "found.score",
                        F.size("found.languages").alias("n_languages"))
