"""The queries of this subpackage, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import bitsliced, bpe, chat, html_extract, lz_fingerprint, minhash_dedup, mixing, quality, secrets, toxicity

QUERIES = {
    "op1_bpe": bpe.query,
    "op2_minhash_dedup": minhash_dedup.query,
    "op3_quality": quality.query,
    "op4_lz_fingerprint": lz_fingerprint.query,
    "op5_bitsliced": bitsliced.query,
    "op6_toxicity": toxicity.query,
    "op7_mixing": mixing.query,
    "op8_secrets": secrets.query,
    "op9_html_extract": html_extract.query,
    "op10_chat": chat.query,
}

ORACLES: dict[str, str] = {
    "op5_bitsliced": bitsliced.ORACLE,
    "op10_chat": chat.ORACLE,
}
