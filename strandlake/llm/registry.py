"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from strandlake.llm import audit, chat, fingerprint, huffman, language, minhash, mixing, packing, quality, repair, suffix, toxicity, warc


def queries() -> dict:
    return {
        "op1_minhash": minhash.op1_minhash,
        "op2_suffix_dedup": suffix.op2_suffix_dedup,
        "op3_packing": packing.op3_packing,
        "op4_quality": quality.op4_quality,
        "op5_token_files": huffman.op5_token_files,
        "op6_fingerprints": fingerprint.op6_fingerprints,
        "op7_chat": chat.op7_chat,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_mixing": mixing.op9_mixing,
        "op10_warc": warc.op10_warc,
        "op11_language_id": language.op11_language_id,
        "op12_conversation_repair": repair.op12_conversation_repair,
        "op13_filter_audit": audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_quality": quality.ORACLE_SQL,
        "op7_chat": chat.ORACLE_SQL,
        "op10_warc": warc.ORACLE_SQL,
        "op12_conversation_repair": repair.ORACLE_SQL,
        "op13_filter_audit": audit.ORACLE_SQL,
    }
