"""Queries and SQL twins of this subpackage."""

from __future__ import annotations

from . import bpe, chat, decontaminate, fim, langid, linededup, minhash, mixing, quality, tokencount, toxicity, variants, warc


def queries() -> dict:
    return {
        "op1_language_id": langid.op1_language_id,
        "op1_page_language": langid.op1_page_language,
        "op2_line_dedup": linededup.op2_line_dedup,
        "op3_decontamination": decontaminate.op3_decontamination,
        "op4_bpe": bpe.op4_bpe,
        "op5_minhash_dedup": minhash.op5_minhash_dedup,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_warc": warc.op7_warc,
        "op8_token_counts": tokencount.op8_token_counts,
        "op9_chat_format": chat.op9_chat_format,
        "op10_quality_rules": quality.op10_quality_rules,
        "op11_fill_in_middle": fim.op11_fill_in_middle,
        "op12_source_mix": mixing.op12_source_mix,
        "op13_spelling_variants": variants.op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_warc": warc.ORACLE,
        "op10_quality_rules": quality.ORACLE,
        "op11_fill_in_middle": fim.ORACLE,
    }
