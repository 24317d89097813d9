"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from tradewinds.llm import hostrules, langid, mixing, ngram_join, packing, pii, quality, tokencount, topk, toxicity
from tradewinds.llm._io import configure, table


def _over(*names, operator):
    def query(spark, sf_dir):
        configure(spark)
        return operator(*(table(spark, sf_dir, n) for n in names))

    return query


QUERIES = {
    "op1_ngram_jaccard": _over("documents", operator=ngram_join.report),
    "op2_pii_votes": _over("documents", operator=pii.report),
    "op3_pivot_topk": _over("embeddings", operator=topk.top_k),
    "op4_quality_pu": _over("documents", "labels", operator=quality.report),
    "op5_mix_sources": _over("documents", operator=mixing.report),
    "op6_token_counts": _over("documents", operator=tokencount.report),
    "op7_toxicity_mil": _over("documents", "labels", operator=toxicity.report),
    "op8_host_rules": _over("documents", operator=hostrules.report),
    "op9_language_ftrl": _over("documents", operator=langid.report),
    "op10_vector_packing": _over("documents", operator=packing.report),
}

ORACLE = {
    "op1_ngram_jaccard": ngram_join.ORACLE,
    "op3_pivot_topk": topk.ORACLE,
    "op5_mix_sources": mixing.ORACLE,
    "op8_host_rules": hostrules.ORACLE,
}
