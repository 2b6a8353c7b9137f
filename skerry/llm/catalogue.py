"""The queries of this subpackage by name, and SQL for those that it can express."""

from __future__ import annotations

from skerry.llm import chat, cover_tree, decontaminate, divergence, html_text, ngram_join, packing, phrases, pii, quality, suffix_dedup, token_counts, warc


def queries() -> dict:
    return {
        "op1_warc_dictionary": warc.op1,
        "op2_html_blocks": html_text.op2,
        "op3_cover_tree_pairs": cover_tree.op3,
        "op4_simhash_decontamination": decontaminate.op4,
        "op5_kneser_ney_quality": quality.op5,
        "op6_ngram_jaccard_join": ngram_join.op6,
        "op7_pii_anchors": pii.op7,
        "op8_retrieval_packing": packing.op8,
        "op9_suffix_array_dedup": suffix_dedup.op9,
        "op10_token_counts": token_counts.op10,
        "op11_prefix_targets": chat.op11,
        "op12_phrase_mining": phrases.op12,
        "op13_source_divergence": divergence.op13,
    }


def oracle_sql() -> dict[str, str]:
    """The others can't be said in SQL: html blocks, SimHash windows, language models, spans with offsets, tokenizers, packing and bytes. Their tests are brute force."""
    return {
        "op1_warc_dictionary": warc.SQL,
        "op3_cover_tree_pairs": cover_tree.SQL,
        "op6_ngram_jaccard_join": ngram_join.SQL,
        "op11_prefix_targets": chat.SQL,
        "op12_phrase_mining": phrases.SQL,
        "op13_source_divergence": divergence.SQL,
    }
