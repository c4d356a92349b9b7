"""The queries of this subpackage: one per operator, over whole tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import collision_ann, collocations, fingerprints, first_fit, mixing, packing, parity_join, prefix_trie, quality, sharding, substring_dedup, suffix_dedup, tokens


def queries() -> dict:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_fingerprints": fingerprints.op2_fingerprints,
        "op3_mixing": mixing.op3_mixing,
        "op4_collision_ann": collision_ann.op4_collision_ann,
        "op5_quality_classifier": quality.op5_quality_classifier,
        "op6_token_counts": tokens.op6_token_counts,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_sharding": sharding.op8_sharding,
        "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
        "op10_parity_join": parity_join.op10_parity_join,
        "op11_collocations": collocations.op11_collocations,
        "op12_first_fit_packing": first_fit.op12_first_fit_packing,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substring_dedup.ORACLE,
        "op9_suffix_dedup": suffix_dedup.ORACLE,
        "op10_parity_join": parity_join.ORACLE,
        "op11_collocations": collocations.ORACLE,
        "op13_prefix_trie": prefix_trie.ORACLE,
    }
