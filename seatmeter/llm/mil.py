"""Quality classifier: attention-based multiple-instance learning (Ilse, Tomczak and Welling, 2018).

A document is a bag of passages of about `PASSAGE_WORDS` words, or, above `PASSAGES` of them, of `PASSAGES` longer ones
that cover the whole text. Every passage is encoded from its own words; gated attention weighs the encodings, and the
weighted mean is scored. Only document labels are needed: the attention learns which passages decide.

Learning uses a bounded sample: `MAX_LABELS` labelled documents at most, chosen by a hash of their ids, of any length.
Their passage features (47 KB a document at most, so 280 MB in all) go to the driver, where a model of a few thousand
numbers is fitted. Scoring is one narrow pass over all texts, without a shuffle, at any size.

Defined cases: null and empty texts, and texts without words, are one passage of zeros and get a score like any other.
Without usable labels every score is 0.5. Labels that are null are ignored; a document with several labels counts once
for each. Repeated rows count once in learning and get equal scores. Extra columns pass through `scored`. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from seatmeter.llm.common import remainder, whole

PASSAGE_WORDS = 80
MAX_LABELS = 6000
PASSAGES = 128               # of a document at most; longer texts have longer passages
PAIR_BINS = 64
HIDDEN, GATE = 32, 16
EPOCHS, BATCH, RATE, DECAY = 15, 64, 0.005, 1e-4

_KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b".", b",", b"!", b"?",
          b"|", b"#*$%&<>", b"\"'()[]{}", b":;-_/\\@^+=~`", bytes(range(128, 192)), bytes(range(192, 256))]
_KIND = np.full(256, len(_KINDS), dtype=np.int64)
for _k, _members in enumerate(_KINDS):
    _KIND[list(_members)] = _k
_BINS = len(_KINDS) + 1
FEATURES = _BINS + PAIR_BINS + 6


def passages(text: bytes | None) -> np.ndarray:
    """One row of features per passage, each from the passage's own words: shares of character kinds and of hashed letter
    pairs, mean word length, distinct words, words equal to the one before, words not seen earlier in the text, words in
    lines that repeat an earlier one, passage size."""
    lines, words = [], []
    for line in (text or b"").split(b"\n"):
        lines.append(line)
        words.append(line.split())
    of_line = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    words = [w for line in words for w in line]
    if not words:
        return np.zeros((1, FEATURES), dtype=np.float32)
    count = min(PASSAGES, -(-len(words) // PASSAGE_WORDS))
    edges = np.arange(count + 1) * len(words) // count
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    stops = ends[edges[1:] - 1]
    sizes = np.diff(stops, prepend=0)
    data = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
    kinds, pairs = np.zeros((count, _BINS)), np.zeros((count, PAIR_BINS))
    for k, (start, stop) in enumerate(zip((stops - sizes).tolist(), stops.tolist())):
        part = data[start:stop]
        kinds[k] = np.bincount(_KIND[part], minlength=_BINS)
        pairs[k] = np.bincount((part[:-1] * np.int64(37) + part[1:]) % PAIR_BINS, minlength=PAIR_BINS)
    known: set[bytes] = set()
    repeated = np.zeros(len(lines))
    for k, line in enumerate(lines):
        if line in known:
            repeated[k] = 1
        else:
            known.add(line)
    n = np.diff(edges).astype(np.float64)
    own, fresh, seen = np.zeros(count), np.zeros(count), set()
    for k, (start, stop) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        distinct = set(words[start:stop])
        own[k], fresh[k] = len(distinct), -len(seen)
        seen |= distinct
        fresh[k] += len(seen)
    same = np.fromiter(map(eq, words, [b"", *words[:-1]]), dtype=np.float64, count=len(words))
    rest = np.column_stack([
        np.minimum(sizes / n, 50) / 10, own / n, np.sqrt(np.add.reduceat(same, edges[:-1]) / n), fresh / n,
        np.add.reduceat(np.repeat(repeated, of_line), edges[:-1]) / n, np.log1p(n) / 5])
    return np.hstack([kinds / sizes[:, None], 4 * np.sqrt(pairs / sizes[:, None]), rest]).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def scores(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Score per bag; bag k has the rows of `x` from starts[k] to the next start."""
        return _forward(self.weights, (x - self.mean) / self.scale, starts)["p"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    bag = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(x)))
    z = x @ w["encode"] + w["encode_bias"]
    h = np.maximum(z, 0)
    tanh, gate = np.tanh(h @ w["tanh"]), _sigmoid(h @ w["gate"])
    e = (tanh * gate) @ w["attend"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a = e / np.add.reduceat(e, starts)[bag]
    mean = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return {"bag": bag, "z": z, "h": h, "tanh": tanh, "gate": gate, "a": a, "mean": mean,
            "p": _sigmoid(mean @ w["score"] + w["score_bias"][0])}


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(w, x, starts)
    ds = (f["p"] - y) / len(y)
    up = (ds[:, None] * w["score"])[f["bag"]]
    da = (up * f["h"]).sum(axis=1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[f["bag"]])
    both = de[:, None] * w["attend"]
    dt = both * f["gate"] * (1 - f["tanh"] ** 2)
    dg = both * f["tanh"] * f["gate"] * (1 - f["gate"])
    dz = (f["a"][:, None] * up + dt @ w["tanh"].T + dg @ w["gate"].T) * (f["z"] > 0)
    return {"score": f["mean"].T @ ds, "score_bias": np.array([ds.sum()]), "attend": (f["tanh"] * f["gate"]).T @ de,
            "tanh": f["h"].T @ dt, "gate": f["h"].T @ dg, "encode": x.T @ dz, "encode_bias": dz.sum(axis=0)}


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 0) -> Model:
    """Adam on the mean log loss. The same bags in the same order give the same model."""
    rng = np.random.default_rng(seed)
    every = np.vstack(bags).astype(np.float64)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 0.02
    bags = [(b - mean) / scale for b in bags]
    w = {"encode": rng.normal(0, FEATURES ** -0.5, (FEATURES, HIDDEN)), "encode_bias": np.zeros(HIDDEN),
         "tanh": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)), "gate": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)),
         "attend": rng.normal(0, GATE ** -0.5, GATE), "score": rng.normal(0, HIDDEN ** -0.5, HIDDEN),
         "score_bias": np.zeros(1)}
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), BATCH):
            chosen = order[k:k + BATCH]
            sizes = np.array([len(bags[i]) for i in chosen])
            got = _gradients(w, np.vstack([bags[i] for i in chosen]), np.cumsum(sizes) - sizes, labels[chosen])
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for name, g in got.items():
                g = g + DECAY * w[name]
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                w[name] = w[name] - rate * (first[name] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-8)
    return Model(mean, scale, w)


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str,
                    max_labels: int = MAX_LABELS) -> DataFrame:
    """The distinct texts and labels of at most `max_labels` ids with labels, left for learning by the hold-out rule."""
    chosen = (labels.select(F.col(key).alias("key"), F.col(label).cast("double").alias("label"))
              .where(F.col("label").isin(0.0, 1.0) & (remainder("key", 3) != 1))
              .distinct().orderBy(F.xxhash64("key"), "key", "label").limit(max_labels))
    texts = docs.select(F.col(key).alias("key"), whole(text).alias("text"))
    # The broadcast side has max_labels rows of two numbers.
    return texts.join(F.broadcast(chosen), "key").dropDuplicates(["key", "label", "text"])


def learned(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
            max_labels: int = MAX_LABELS) -> Model | None:
    sample = labelled_sample(docs, labels, key, text, label, max_labels)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                "hash": batch["hash"], "label": batch["label"],
                "bag": [passages(bytes(t)).tobytes() for t in batch["text"]]})

    rows = (sample.select(F.xxhash64("key", "text").alias("hash"), "label", F.col("text").cast("binary").alias("text"))
            .mapInPandas(encode, "hash long, label double, bag binary")
            # An id may have many texts. They are cut on the executors: as the last step, the limit would run on the driver.
            .orderBy("hash", "label").limit(max_labels).coalesce(1).collect())
    rows = sorted(rows)
    y = np.array([r["label"] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    return fit([np.frombuffer(r["bag"], dtype=np.float32).reshape(-1, FEATURES) for r in rows], y)


def score(text: Column, model: Model | None) -> Column:
    """Probability that the label is 1, from the text alone."""
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf(DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for k in range(0, len(texts), 512):
                bags = [passages(t) for t in texts.iloc[k:k + 512]]
                sizes = np.array([len(b) for b in bags])
                out.append(model.scores(np.vstack(bags), np.cumsum(sizes) - sizes))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return run(text.cast("binary"))


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
           into: str = "score", max_labels: int = MAX_LABELS) -> DataFrame:
    """`docs` with the score in a column `into` (replacing one of that name)."""
    return docs.withColumn(into, score(F.col(text), learned(docs, labels, key, text, label, max_labels)))


def quality_report(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, held_out, score, predicted. A null key counts as not held out."""
    return scored(docs.select(*dict.fromkeys([key, text])), labels, key, text, into="score").select(
        key, F.coalesce(remainder(key, 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def rejected_removed(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents predicted to have label 1, with the columns they came with."""
    return docs.where(score(F.col(text), learned(docs, labels, key, text)) >= 0.5)
