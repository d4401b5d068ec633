"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tidewatch.llm import bpe, html_text, jaccard, media, mixing, pitman_yor, quality, token_files, tokens, urls

QUERIES = {
    "op1_media": media.op1_media,
    "op2_pitman_yor": pitman_yor.op2_pitman_yor,
    "op3_token_counts": tokens.op3_token_counts,
    "op4_mixing": mixing.op4_mixing,
    "op5_html_text": html_text.op5_html_text,
    "op6_token_files": token_files.op6_token_files,
    "op7_quality": quality.op7_quality,
    "op8_jaccard": jaccard.op8_jaccard,
    "op9_url_filter": urls.op9_url_filter,
    "op10_bpe": bpe.op10_bpe,
}
ORACLES: dict[str, str] = {"op7_quality": quality.OP7_SQL, "op4_mixing": mixing.OP4_SQL, "op8_jaccard": jaccard.OP8_SQL, "op9_url_filter": urls.OP9_SQL}
