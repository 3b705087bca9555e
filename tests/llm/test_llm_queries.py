"""The registered corpus queries against their SQL on the smallest tables, and the pipeline's stages."""

import hashlib
import struct

import pytest
from oracle_tool import compare, connect

import corpus_pipeline
from vaxframe.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, con, name):
    problems, n, _, _ = compare(spark, name, queries.QUERIES[name], queries.ORACLES[name], SF, con)
    assert n and not problems, problems


@pytest.mark.parametrize("name", ["op1_quality_classifier", "op2_sentencepiece", "op4_pii", "op6_quality_rules", "op7_secret_scans", "op9_sharding"])
def test_a_row_per_document(spark, name):
    ids = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()
    assert sorted(r.doc_id for r in queries.QUERIES[name](spark, SF).select("doc_id").collect()) == sorted(r.doc_id for r in ids)


def test_pipeline_stages(spark):
    """Each stage's decision is what its operator says about the stage's own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    kept = corpus_pipeline.quality_rules(spark, docs, SF)
    good = {r.doc_id for r in queries.QUERIES["op6_quality_rules"](spark, SF).where("kept").collect()}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == good < ids
    unique = corpus_pipeline.near_duplicates(spark, docs, SF)
    roots = {r.component_id for r in queries.QUERIES["op5_ngram_jaccard_join"](spark, SF).collect()}
    assert unique.columns == columns and {r.doc_id for r in unique.collect()} == roots
    clean = corpus_pipeline.benchmark_decontamination(spark, docs, SF)
    free = {r.doc_id for r in queries.QUERIES["op3_benchmark_decontamination"](spark, SF).where("not contaminated").collect()}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == free
    masked = corpus_pipeline.personal(spark, docs, SF)
    assert masked.columns == columns and masked.where("text rlike '[A-Za-z0-9]@[A-Za-z0-9-]+[.][a-z]'").count() == 0
    done = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in done.collect()} <= good & ids and done.where("not round_trip").count() == 0


def test_repeated_rows_leave_one(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f g"), (None, "other words here"), (None, "other words here")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id or 0) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == [0, 0, 1]


def test_unlike_texts_under_one_id_stay(spark):
    base = "a b c d e f g"
    rows = [(1, base), (5, base), (5, "quite other words stand in here"), (9, "x y z one two three"), (9, "p q r four five six"), (3, ""), (3, ""), (3, " ")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted([(1, base), *rows[2:6], (3, " ")])


def test_pieces_are_returned(spark):
    for r in queries.QUERIES["op2_sentencepiece"](spark, SF).collect():
        assert len(r.pieces) == r.n_pieces and hashlib.sha256(struct.pack(f"<{r.n_pieces}i", *r.pieces)).hexdigest() == r.pieces_sha256
