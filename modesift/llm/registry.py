"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import op1_media, op2_pii, op3_pack, op4_toxicity, op5_quality, op6_ctw, op7_jaccard, op8_graph, op9_mix, op10_warc, op11_decontaminate, op12_negatives, op13_search

QUERIES = {
    "op1_signature_sniffing": op1_media.query,
    "op2_information_sanitisation": op2_pii.query,
    "op3_best_fit_packing": op3_pack.query,
    "op4_clause_grammar": op4_toxicity.query,
    "op5_empirical_bayes_quality": op5_quality.query,
    "op6_context_tree_weighting": op6_ctw.query,
    "op7_prefix_tree_join": op7_jaccard.query,
    "op8_robust_graph": op8_graph.query,
    "op9_source_mixing": op9_mix.query,
    "op10_merkle_fixity": op10_warc.query,
    "op11_benchmark_decontamination": op11_decontaminate.query,
    "op12_hard_negatives": op12_negatives.query,
    "op13_ranked_search": op13_search.query,
}
ORACLES: dict[str, str] = {
    "op7_prefix_tree_join": op7_jaccard.ORACLE,
    "op8_robust_graph": op8_graph.ORACLE,
    "op10_merkle_fixity": op10_warc.ORACLE,
    "op11_benchmark_decontamination": op11_decontaminate.ORACLE,
    "op12_hard_negatives": op12_negatives.ORACLE,
    "op13_ranked_search": op13_search.ORACLE,
}
