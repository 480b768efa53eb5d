import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from seatmeter.llm import repeats as q
from tests.llm.cases import SF, edge_docs


def brute(texts, length):
    """(spans, kept) of each text, from a count of all strings of that length."""
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, dtype=np.int8)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i + 1:i + length + 1] = 1
        edges = np.flatnonzero(np.diff(gone)).tolist()
        kept = bytes(np.frombuffer(t, dtype=np.uint8)[gone[1:-1] == 0])
        out.append((list(zip(edges[::2], edges[1::2])), kept))
    return out


def found(spark, texts, length, parts=3):
    docs = spark.createDataFrame([(k, t.decode("latin-1")) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in q.repeats_removed(docs.repartition(parts), length=length).collect()}
    return [([(s.start, s.stop) for s in rows[k].spans], bytes(rows[k].kept)) for k in range(len(texts))]


def corpus(rng, alphabet, length):
    """Passages shared at other places, by a few or by many, changed here and there; periodic stretches."""
    text = lambda n: bytes(rng.choice(alphabet) for _ in range(n))
    shared = [text(rng.randint(length // 2, 4 * length)) for _ in range(6)] + [text(3) * length, text(1) * 5 * length]
    out = []
    for _ in range(40):
        t = b""
        for _ in range(rng.randint(0, 4)):
            piece = bytearray(rng.choice(shared))
            cut = rng.randint(0, len(piece) // 2)
            piece = piece[cut:] if rng.random() < 0.5 else piece[:len(piece) - cut]
            for _ in range(rng.randint(0, 1)):
                piece[rng.randrange(len(piece))] = rng.choice(alphabet)
            t += text(rng.randint(0, length)) * (rng.random() < 0.6) + bytes(piece)
        out.append(t)
    return out + [out[3], out[3], b"", text(length - 1), text(length)]


@pytest.mark.parametrize("length,alphabet", [(20, b"ab"), (37, b"abcd"), (64, b"ab"), (400, b"abcdefgh"), (5, b"abcdefghijkl")])
def test_against_all_strings(spark, length, alphabet):
    texts = corpus(random.Random(length), alphabet, length)
    assert found(spark, texts, length) == brute(texts, length)


def test_shards_buckets_and_shuffled_spans(spark, monkeypatch):
    """Closures carry module globals by name only, so the sizes that tasks use stay as they are here."""
    monkeypatch.setattr(q, "BUCKET_BYTES", 2_000)
    monkeypatch.setattr(q, "BROADCAST_SPANS", 0)
    texts = corpus(random.Random(1), b"abc", 50)
    assert found(spark, texts, 50, parts=7) == brute(texts, 50)


@pytest.mark.parametrize("length", [400, 20, 7, 2])
def test_anchors_depend_on_the_string_alone(length):
    shape = q.Shape(length)
    assert shape.reach + shape.gram - 1 <= length and shape.block <= length - shape.reach
    rng = np.random.default_rng(length)
    core = rng.integers(0, 3, length + 30).astype(np.uint8)
    sides = [np.concatenate([rng.integers(0, 3, 777).astype(np.uint8), core, rng.integers(0, 3, 500).astype(np.uint8)])
             for _ in range(3)]
    picked = [q._anchors(q._hashes(s, shape)[0], shape.reach)[777:777 + 30] - 777 for s in sides]
    assert (picked[0] == picked[1]).all() and (picked[0] == picked[2]).all()


def test_rows_cut_at_the_ends_of_pieces(monkeypatch):
    """Every string belongs to one row, whatever the pieces, and its row tells which bytes it covers."""
    shape, rng = q.Shape(50), np.random.default_rng(4)
    data = np.tile(rng.integers(0, 4, 900).astype(np.uint8), 3)
    valid = np.ones(len(data), dtype=bool)
    valid[1000:1060] = valid[-49:] = False
    for piece in (1 << 17, 300, 64):
        monkeypatch.setattr(q, "PIECE", piece)
        start, n, follows, every = q.anchored(data, valid, shape)
        strings = [i for a, k in zip(start.tolist(), n.tolist()) for i in range(a, a + k)]
        assert strings == np.flatnonzero(valid).tolist() and n.max() <= shape.reach
        covered = {}
        for a, k, f, e in zip(start.tolist(), n.tolist(), follows.tolist(), every.tolist()):
            assert covered.setdefault((f, e), bytes(data[a:a + k + 49])) == bytes(data[a:a + k + 49])


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = {r.doc_id: r for r in queries()["op13_suffix_array_dedup"](spark, SF).collect()}
    texts = [(d.text or "").encode() for d in docs]
    removed = 0
    for d, t, (spans, kept) in zip(docs, texts, brute(texts, 400)):
        r = rows[d.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(t), sum(b - a for a, b in spans), len(spans))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
        removed += r.n_removed
    assert len(rows) == len(docs) and removed > 10_000


def test_edges(spark):
    docs = edge_docs(spark)
    rows = q.repeats_removed(docs, length=100).collect()
    given = docs.collect()
    texts = [(d.text or "").encode() for d in given]
    want = sorted((str(d.doc_id), spans, kept) for d, (spans, kept) in zip(given, brute(texts, 100)))
    assert sorted((str(r.doc_id), [(s.start, s.stop) for s in r.spans], bytes(r.kept)) for r in rows) == want
    assert q.repeats_removed(edge_docs(spark, [])).count() == 0


def test_long_blanks(spark):
    texts = [b" " * 1_000_000, b"\n" * 500 + b"x" * 399, b"\n" * 399]
    assert [s for s, _ in found(spark, texts, 400)] == [[(0, 1_000_000)], [(0, 500)], []]


def test_a_passage_with_other_bytes_about_it_everywhere_is_spread_out(spark):
    """Rows of one prefix, each with other bytes before and after it, lie in all buckets, and are still compared."""
    rng = random.Random(3)
    text = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    passage = text(90)
    texts = [text(60) + passage + text(60) for _ in range(400)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "uid long, data binary").repartition(3)
    merged = q.interleaved(q._anchored_shards(docs, q.Shape(80), 8), 8, "test")
    kinds = {r.batch: len(r.data) // 20 for r in merged.where(F.col("bucket") == q._KINDS).collect()}
    assert len(kinds) == 8 and max(kinds.values()) < 2 * sum(kinds.values()) / 8
    assert q.differing(merged, 8).count() > 0
    assert found(spark, texts, 80) == brute(texts, 80)


def test_a_bucket_merges_as_it_goes(monkeypatch):
    """Rows from many shards, merged in one go or every few rows: the same repeats, each told once, and the same kinds."""
    rng = np.random.default_rng(6)
    sent = []
    for batch in range(60):
        rows = np.zeros(10, dtype=q._ROW)
        rows["follows"], rows["all"] = rng.integers(0, 30, 10), rng.integers(0, 4, 10)
        rows["place"] = np.arange(10)
        rows = rows[np.unique(rows[["follows", "all"]], return_index=True)[1]]
        rows["place"][rng.random(len(rows)) < 0.1] |= q._TWICE
        sent.append((batch, rows))
    results = []
    for limit in (1 << 30, 25, 0):
        monkeypatch.setattr(q, "MERGED_ROWS", limit)
        merge, out = q.Interleave(7), []
        for batch, rows in sent:
            out += merge.take(batch, rows.tobytes())
        out += merge.rest()
        told = sorted((b, p) for n, b, d in out if n == q._REPEATS for p in np.frombuffer(d, "<u4").tolist())
        assert len(told) == len(set(told))
        kinds = [q._kinds(d) for n, _, d in out if n == q._KINDS]
        assert len(kinds) == 1
        results.append((told, sorted(kinds[0][0].tolist())))
    assert results[0] == results[1] == results[2]
    every = {}
    for batch, rows in sent:
        for f, a, p in rows.tolist():
            every.setdefault((f, a), []).append((batch, p))
    want = sorted((b, p & 0x7FFFFFFF) for places in every.values() for b, p in places
                  if len(places) > 1 or any(x & int(q._TWICE) for _, x in places))
    assert results[0][0] == want
