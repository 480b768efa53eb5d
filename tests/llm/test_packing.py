import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from seatmeter.llm import packing as q
from tests.llm.cases import SF, edge_docs


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_the_tokenizer_file(spark, tokenizer):
    texts = [r.text or "" for r in edge_docs(spark).collect()]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += ["a<|endoftext|>b", "<|endoftext|>", " \n\n  x\t", "don't I'LL we've 1234 ½ é", "\x00\x1f�"]
    for text in texts:
        assert q.token_ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("blank", [" ", "\n", "\t", "\u00a0", " \n\t", "\r\n"])
def test_long_runs_of_blanks(tokenizer, blank):
    for n in (1_000, 400_000, 1_000_000):
        for text in (blank * n, f"a b{blank * n}c d", f"<|endoftext|>{blank * n}"):
            assert q.token_ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [0]


def test_very_long_run_and_word(tokenizer):
    for text in ("x" + " " * 5_000_000 + "y", "w" * 3_000_000):
        assert q.token_ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [0]


def test_one_shard_to_a_task(spark):
    short = spark.range(500).selectExpr("id AS row", "id % 40 + 1 AS size")
    found = q.places(short, 10, 41)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    assert found.rdd.getNumPartitions() == 10 and found.selectExpr("seq >> 32 AS s", "spark_partition_id() AS p").distinct().count() == 10


def test_cuts():
    assert q.cuts(1) == [(0, 1)] and q.cuts(2048) == [(0, 2048)] and q.cuts(2049) == [(0, 1), (1, 2048)]
    assert q.cuts(5000) == [(0, 904), (904, 2048), (2952, 2048)]


@pytest.mark.parametrize("source", ["edges", "table"])
def test_round_trip(spark, tokenizer, source):
    """Reading the sequences at the pieces' places gives every document's ids."""
    docs = edge_docs(spark) if source == "edges" else spark.read.parquet(f"{SF}/documents.parquet")
    packed = q.pack(q.pieces(docs)).collect()
    held = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        content = held.setdefault(r.sequence_id, [])
        assert r.offset == len(content) and len(r.ids) == r.length and 1 <= r.length
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        content += r.ids
    assert max(map(len, held.values())) <= 2048
    assert len(packed) == sum(len(q.cuts(len(q.token_ids(r.text)))) for r in docs.collect())
    by_piece = {}
    for r in packed:
        by_piece.setdefault((r.doc_id, r.piece), []).append(held[r.sequence_id][r.offset:r.offset + r.length])
    for d in docs.collect():
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids + [0]
        for k, (start, n) in enumerate(q.cuts(len(ids))):
            assert ids[start:start + n] in by_piece[d.doc_id, k]
    assert len(held) <= np.ceil(sum(r.length for r in packed) / 2048) * 1.05 + 1


def test_sequences_hold_every_token_once(spark):
    docs = edge_docs(spark)
    rows = q.sequences(docs, length=64).collect()
    assert max(len(r.ids) for r in rows) <= 64
    assert sum(len(r.ids) for r in rows) == sum(len(q.token_ids(r.text)) for r in docs.collect())


def test_rule_picks_the_smallest_sum_of_squares():
    sequence, offset = q.placed(np.array([6, 4, 6, 4, 5, 5]), 10)
    fill = {}
    for s, n in zip(sequence, [6, 4, 6, 4, 5, 5]):
        fill[s] = fill.get(s, 0) + n
    assert max(fill.values()) <= 10 and len(fill) <= 4
    a = q.placed(np.array([6, 4, 6, 4, 5, 5]), 10)
    assert np.array_equal(a[0], sequence) and np.array_equal(a[1], offset)


def test_waste_is_small():
    lengths = np.minimum(np.random.default_rng(1).geometric(1 / 600, 30_000), 2047)
    sequence, _ = q.placed(lengths, 2048)
    assert len(set(sequence.tolist())) <= lengths.sum() / 2048 * 1.005


def test_several_shards_and_own_columns(spark):
    parts = spark.range(500).selectExpr("id", "cast(id % 40 + 1 as int) AS length", "'x' AS row", "1 AS size")
    packed = q.pack(parts, capacity=40, shard_pieces=50)
    assert packed.columns == ["id", "length", "row", "size", "sequence_id", "offset"] and packed.count() == 500
    sums = packed.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in sums) <= 40


def test_empty(spark):
    assert q.pack(q.pieces(edge_docs(spark, []))).count() == 0


@pytest.mark.parametrize("few", [500_000, 0])
def test_compact_ids_and_both_joins(spark, monkeypatch, few):
    monkeypatch.setattr(q, "BROADCAST_PIECES", few)
    docs = edge_docs(spark)
    key = lambda r: (str(r.doc_id), r.piece, r.ids)
    a, b = (sorted(df.collect(), key=key) for df in (q.packed_ids(docs, length=64, also=("key",)), q.pack(q.pieces(docs, length=64), capacity=64)))
    assert [key(r) for r in a] == [key(r) for r in b]
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) and r.key == f"k{r.doc_id}" for r in a)
    fill = {}
    for r in a:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 64
