"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from thermaline.llm import (divergence, hashing_index, language, packing, pieces, pivot_clusters, privacy, quality, simhash, spans, substrings, toxicity,
                            vector_graph)
from thermaline.llm.common import table


def _documents(operator):
    return lambda spark, sf: operator(table(spark, sf, "documents"))


QUERIES = {
    "op1_suffix_array_dedup": _documents(substrings.op1),
    "op2_simhash_near_dedup": _documents(simhash.op2),
    "op3_nearest_neighbours": lambda spark, sf: hashing_index.op3(table(spark, sf, "embeddings")),
    "op4_best_fit_packing": _documents(packing.op4),
    "op5_language_id": _documents(language.op5),
    "op6_toxicity": lambda spark, sf: toxicity.op6(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op7_sentencepiece": _documents(pieces.op7),
    "op8_substring_dedup": _documents(spans.op8),
    "op9_pii_surrogates": _documents(privacy.op9),
    "op10_quality_rules": _documents(quality.op10),
    "op11_vector_graph": lambda spark, sf: vector_graph.op11(table(spark, sf, "embeddings")),
    "op12_pivot_clusters": lambda spark, sf: pivot_clusters.op12(table(spark, sf, "embeddings")),
    "op13_source_divergence": _documents(divergence.op13),
}

ORACLES = {
    "op10_quality_rules": quality.OP10_SQL,
    "op11_vector_graph": vector_graph.OP11_SQL,
    "op12_pivot_clusters": pivot_clusters.OP12_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
