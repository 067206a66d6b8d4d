"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from ownergraph.llm import bpe, chat, fingerprint, html_text, line_dedup, minhash, packing, secrets, toxicity, webp


def queries() -> dict:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_html": html_text.op2_html,
        "op3_fingerprint": fingerprint.op3_fingerprint,
        "op4_packing": packing.op4_packing,
        "op5_chat": chat.op5_chat,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_secrets": secrets.op7_secrets,
        "op8_webp": webp.op8_webp,
        "op9_minhash": minhash.op9_minhash,
        "op10_line_dedup": line_dedup.op10_line_dedup,
    }


def oracle_sql() -> dict:
    return {
        "op5_chat": chat.OP5_SQL,
        "op9_minhash": minhash.OP9_SQL,
        "op10_line_dedup": line_dedup.OP10_SQL,
    }
