"""The queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, jaccard, language_id, line_dedup, piece_codec, quality, secrets, sharding, suffix_dedup

QUERIES = {
    "op1_chat_format": chat.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_language_id": language_id.query,
    "op4_line_dedup": line_dedup.query,
    "op5_sharding": sharding.query,
    "op6_quality_rules": quality.query,
    "op7_jaccard_join": jaccard.query,
    "op8_secret_scan": secrets.query,
    "op9_piece_codec": piece_codec.query,
    "op10_decontaminate": decontaminate.query,
}

ORACLES = {
    "op2_suffix_dedup": suffix_dedup.ORACLE,
    "op7_jaccard_join": jaccard.ORACLE,
    "op6_quality_rules": quality.ORACLE,
    "op8_secret_scan": secrets.ORACLE,
    "op1_chat_format": chat.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op10_decontaminate": decontaminate.ORACLE,
    "op5_sharding": sharding.ORACLE,
}
