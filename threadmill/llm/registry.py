"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import bpe, chat, decontaminate, html_main, jaccard, licenses, quality, search, sharding, urls

_QUERIES = {
    "op1_license_scan": licenses.query,
    "op4_attention_mil_quality": quality.query,
    "op5_wu_manber_decontamination": decontaminate.query,
    "op6_min_cut_html": html_main.query,
    "op7_pair_index_bpe": bpe.query,
    "op8_typed_chat_format": chat.query,
    "op9_url_reputation": urls.query,
    "op2_block_max_wand_search": search.query,
    "op3_jump_hash_sharding": sharding.query,
    "op10_prefix_tree_jaccard": jaccard.query,
}
_ORACLES: dict[str, str] = {
    "op1_license_scan": licenses.SQL,
    "op2_block_max_wand_search": search.SQL,
    "op5_wu_manber_decontamination": decontaminate.SQL,
    "op8_typed_chat_format": chat.SQL,
    "op9_url_reputation": urls.SQL,
    "op10_prefix_tree_jaccard": jaccard.SQL,
}


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {**_QUERIES, "pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
