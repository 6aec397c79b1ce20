"""Every operator and pipeline stage over nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from thermaline.llm import hashing_index, language, packing, pieces, privacy, quality, simhash, spans, substrings, toxicity

OPERATORS = {
    "op1": substrings.op1, "op2": simhash.op2, "op4": packing.op4, "op5": language.op5, "op7": pieces.op7, "op8": spans.op8, "op9": privacy.op9,
    "op10": quality.op10,
    "op6": lambda docs: toxicity.op6(docs, docs.select("doc_id", F.lit(None).cast("int").alias("toxic"), F.lit(1).alias("did"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_input_row(name, edge_docs):
    out = OPERATORS[name](edge_docs)
    rows = out.where("piece = 0").collect() if name == "op4" else out.collect()
    assert len(rows) == 12
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in edge_docs.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, no_docs):
    assert OPERATORS[name](no_docs).collect() == []


def test_stages_on_edges(edge_docs, no_docs, sf, spark):
    columns = edge_docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, edge_docs, sf)
        assert stage(spark, no_docs, sf).count() == 0
        if name != "packing":
            assert out.columns == columns
        n = out.count()
        assert n == 12 if name in ("toxicity", "pii") else n > 0


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, None]), (6, [1.0, 2.0, 3.0]), (7, [0.5, 0.5]),
            (None, [1.0, 1.0]), (8, [0.5, 0.5]), (20, [0.0, 1.0]), (9, [])]
    df = spark.createDataFrame([(i, v, "a") for i, v in rows], "vec_id long, embedding array<float>, x string")
    out = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in hashing_index.op3(df).collect()}
    assert out[0, 1] == (7, 0.5) and out[0, 2] == (8, 0.5) and out[0, 3] == (20, 0.0) and (0, 4) not in out
    assert {q for q, _ in out} == {0, 20}
    assert hashing_index.op3(df.limit(0)).collect() == []
    assert hashing_index.op3(df.where("vec_id = 7")).collect() == []


def test_null_text_results(edge_docs):
    one = {r["doc_id"]: r for r in substrings.op1(edge_docs).collect()}
    assert (one[2]["n_bytes"], one[2]["n_removed"], one[2]["n_spans"]) == (0, 0, 0)
    assert one[2]["kept_sha256"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    two = {r["doc_id"]: r for r in simhash.op2(edge_docs).collect()}
    assert two[2]["fingerprint"] == "0" * 16 and two[3]["component_id"] == 2 and two[5]["component_id"] == 2
    five = {r["doc_id"]: r for r in language.op5(edge_docs).collect()}
    assert five[2]["lang_pred"] == "und" and five[5]["lang_pred"] == "und" and five[1]["lang_pred"] == "en"
    nine = {r["doc_id"]: r for r in privacy.op9(edge_docs).collect()}
    assert nine[2]["text"] is None and nine[3]["text"] == ""
    ten = {r["doc_id"]: r for r in quality.op10(edge_docs).collect()}
    assert ten[2]["base_failed"] and not ten[2]["kept"]
