"""The queries of this package and their DuckDB twins."""
from __future__ import annotations

from . import bpe, chat, jaccard, media, mixing, quality, quality_rules, sharding, simhash, spelling, tokencounts, urlfilter, wand


def queries() -> dict:
    return {
        "op1_length_histogram": tokencounts.op1_length_histogram,
        "op2_recursive_bpe": bpe.op2_recursive_bpe,
        "op3_rule_ensemble": quality.op3_rule_ensemble,
        "op6_chosen_path": jaccard.op6_chosen_path,
        "op7_boosted_rules": quality_rules.op7_boosted_rules,
        "op4_archive_source": media.op4_archive_source,
        "op5_redirect_equivalence": urlfilter.op5_redirect_equivalence,
        "op8_extendible_hashing": sharding.op8_extendible_hashing,
        "op9_sainte_lague": mixing.op9_sainte_lague,
        "op10_reply_trees": chat.op10_reply_trees,
        "op11_pivot_tables": simhash.op11_pivot_tables,
        "op12_block_max_wand": wand.op12_block_max_wand,
        "op13_deletion_keys": spelling.op13_deletion_keys,
        "url_aliases_planted": urlfilter.planted_aliases,
        "shards_of_200_kb": sharding.small_shards,
    }


def oracle_sql() -> dict:
    return {
        "op5_redirect_equivalence": urlfilter.oracle(),
        "op8_extendible_hashing": sharding.oracle(),
        "op9_sainte_lague": mixing.ORACLE,
        "op10_reply_trees": chat.ORACLE,
        "op12_block_max_wand": wand.ORACLE,
        "url_aliases_planted": urlfilter.oracle(urlfilter.PLANTED),
        "shards_of_200_kb": sharding.oracle(200_000),
    }
