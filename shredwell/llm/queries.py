"""The queries of this package, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, exact, language, media, mixing, near, packing, quality, substring, tokens

QUERIES = {
    "op1_media": media.op1_media,
    "op2_quality": quality.op2_quality,
    "op3_packing": packing.op3_packing,
    "op4_exact": exact.op4_exact,
    "op5_language": language.op5_language,
    "op6_minhash": near.op6_minhash,
    "op7_substring": substring.op7_substring,
    "op8_mixing": mixing.op8_mixing,
    "op9_tokens": tokens.op9_tokens,
    "op10_chat": chat.op10_chat,
}

ORACLE_SQL = {
    "op4_exact": exact.ORACLE_OP4,
    "op10_chat": chat.ORACLE_OP10,
}
