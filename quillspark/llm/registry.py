"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, chat_format, exact_dedup, html_extract, language_id, mixing, ngram_join, packing, quality, warc

QUERIES = {
    "op1_html_extract": html_extract.op1_html_extract,
    "op2_mixing": mixing.op2_mixing,
    "op3_ann_search": ann.op3_ann_search,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_warc": warc.op7_warc,
    "op8_quality": quality.op8_quality,
    "op9_language_id": language_id.op9_language_id,
    "op10_packing": packing.op10_packing,
}

ORACLES = {
    "op4_chat_format": chat_format.ORACLE,
    "op5_ngram_join": ngram_join.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op7_warc": warc.ORACLE,
}
