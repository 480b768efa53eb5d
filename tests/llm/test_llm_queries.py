"""Every registered query of this subpackage on the smallest tables, against SQL where there is any."""

import glob
import os

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from __spark_entry__ import oracle_sql, queries
from seatmeter.llm import mil, mixing, packing, quality_rules, simhash
from seatmeter.llm.common import table
from seatmeter.llm.queries import ORACLES, QUERIES
from tests.llm.cases import SF
from tools.check import rows_of

COLUMNS = {
    "op1": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2": "doc_id piece start length ids_crc32 sequence_id offset",
    "op3": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op4": "query_id rank vec_id score", "op5": "doc_id held_out score predicted",
    "op6": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op7": "doc_id fingerprint component_id", "op8": "doc_id source epoch block place",
    "op9": "page_id host fetched_s verdict entry category", "op10": "doc_id held_out lang_pred score",
    "op11": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op13": "doc_id n_bytes n_removed n_spans kept_sha256", "op12": "vec_id component n deviation whitened explained identity_error"}


def test_all_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == set(COLUMNS)
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, name):
    found = queries()[name](spark, SF)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(found.columns) and found.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found, cursor = queries()[name](spark, SF), db.execute(oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows_of(found.columns, found.collect()) == rows_of(columns, cursor.fetchall())


def test_pipeline_stage_by_stage(spark):
    """Each stage's rows follow from the report of its operator on the stage's own input."""
    docs = table(spark, SF, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "quality classifier", "SimHash near-dedup", "mixing sources to target weights",
                     "best-fit packing"]
    held = [docs]
    for _, stage in corpus_pipeline.STAGES:
        held.append(stage(spark, held[-1], SF).cache())
    assert all(h.columns == docs.columns for h in held[:-1])
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(held[1]) == ids(quality_rules.rule_report(docs).where("kept"))
    assert ids(held[2]) == ids(mil.quality_report(held[1], table(spark, SF, "labels")).where("predicted = 1"))
    assert ids(held[3]) == ids(simhash.near_duplicates(held[2]).where("doc_id = component_id"))
    assert ids(held[4]) == ids(mixing.mixing_report(held[3]))
    tokens = sum(len(packing.token_ids(r.text)) for r in held[4].collect())
    assert held[5].selectExpr("sum(length)").first()[0] == tokens
    assert max(r[1] for r in held[5].groupBy("sequence_id").sum("length").collect()) <= 2048
    assert corpus_pipeline.run(spark, SF).count() == held[5].count()
    # Read back from the sequences, every copy is a kept text.
    tokenizer, content = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for r in held[5].orderBy("sequence_id", "offset").collect():
        content.setdefault(r.sequence_id, []).extend(r.ids)
    read = {}
    for r in held[5].orderBy("doc_id", "copy", "piece").collect():
        read.setdefault((r.doc_id, r.copy), []).extend(content[r.sequence_id][r.offset:r.offset + r.length])
    assert sorted((d, tokenizer.decode(ids[:-1])) for (d, _), ids in read.items()) == sorted(
        (r.doc_id, r.text) for r in held[4].collect())


def test_pipeline_on_edges(spark):
    from tests.llm.cases import edge_docs

    held = edge_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        held = stage(spark, held, SF)
    assert held.count() >= 1
    held = edge_docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        held = stage(spark, held, SF)
    assert held.count() == 0
