"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import chat, exact_dedup, fingerprints, jaccard_join, line_dedup, lm_scoring, mixing, packing, periodic_runs, sharding, toxicity, url_filter, vector_codes


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_document_fingerprints": fingerprints.op2_document_fingerprints,
        "op3_sharding": sharding.op3_sharding,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_chat_format": chat.op5_chat_format,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_best_fit_packing": packing.op8_best_fit_packing,
        "op9_jaccard_join": jaccard_join.op9_jaccard_join,
        "op10_mixing": mixing.op10_mixing,
        "op11_lm_scoring": lm_scoring.op11_lm_scoring,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_periodic_runs": periodic_runs.op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.OP1_SQL,
        "op5_chat_format": chat.OP5_SQL,
        "op6_exact_dedup": exact_dedup.OP6_SQL,
        "op9_jaccard_join": jaccard_join.OP9_SQL,
        "op12_vector_codes": vector_codes.OP12_SQL,
        "op13_periodic_runs": periodic_runs.OP13_SQL,
    }
