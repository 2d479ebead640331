"""Queries and SQL of the corpus operators."""

from __future__ import annotations

from sparkseam.llm import (
    bpe, chat, jaccard_join, language_id, line_quality, packing, pii, resampling, shard_table, toxicity, url_filter, winnow, word_runs)


def queries() -> dict:
    return {
        "op1_line_quality": line_quality.op1_line_quality,
        "op2_char_tagger": pii.op2_char_tagger,
        "op3_reply_trees": chat.op3_reply_trees,
        "op4_bm25_packing": packing.op4_bm25_packing,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_ngram_join": jaccard_join.op6_ngram_join,
        "op7_shard_table": shard_table.op7_shard_table,
        "op8_winnowing": winnow.op8_winnowing,
        "op9_url_filters": url_filter.op9_url_filters,
        "op10_sentencepiece": bpe.op10_sentencepiece,
        "op11_periodic_runs": word_runs.op11_periodic_runs,
        "op12_language_id": language_id.op12_language_id,
        "op13_importance_resampling": resampling.op13_importance_resampling,
    }


def oracle_sql() -> dict:
    return {
        "op1_line_quality": line_quality.ORACLE,
        "op3_reply_trees": chat.ORACLE,
        "op6_ngram_join": jaccard_join.ORACLE,
        "op7_shard_table": shard_table.ORACLE,
        "op9_url_filters": url_filter.ORACLE,
        "op13_importance_resampling": resampling.ORACLE,
    }
