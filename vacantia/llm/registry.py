"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from vacantia.llm import decontaminate, fim, html_text, jaccard, language, minhash, mixing, quality, secrets, suffix_dedup, token_files, topk, whitening


def queries() -> dict:
    return {
        "op1_decontaminate": decontaminate.op1,
        "op2_quality": quality.op2,
        "op3_token_files": token_files.op3,
        "op4_topk_search": topk.op4,
        "op5_html_text": html_text.op5,
        "op6_suffix_dedup": suffix_dedup.op6,
        "op7_language": language.op7,
        "op8_mix_sources": mixing.op8,
        "op9_secrets": secrets.op9,
        "op10_jaccard_join": jaccard.op10,
        "op11_fingerprints": minhash.op11,
        "op12_whitening": whitening.op12,
        "op13_fill_in_middle": fim.op13,
    }


def oracle_sql() -> dict:
    return {
        "op1_decontaminate": decontaminate.ORACLE,
        "op4_topk_search": topk.ORACLE,
        "op8_mix_sources": mixing.ORACLE,
        "op13_fill_in_middle": fim.ORACLE,
    }
