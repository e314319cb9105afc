"""The queries of this package and their SQL."""

from __future__ import annotations

from foliospark.llm import (
    chat_format,
    decontamination,
    exact_dedup,
    language_id,
    mixing,
    near_dedup,
    quality,
    sentence_spans,
    suffix_array,
    url_filter,
)

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_source_mixing": mixing.op2_source_mixing,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_suffix_array": suffix_array.op4_suffix_array,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_language_id": language_id.op7_language_id,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_sentence_spans": sentence_spans.op9_sentence_spans,
    "op10_quality_classifier": quality.op10_quality_classifier,
}
ORACLES = {
    "op4_suffix_array": suffix_array.ORACLE,
    "op1_decontamination": decontamination.ORACLE,
    "op2_source_mixing": mixing.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
    "op8_chat_format": chat_format.ORACLE,
    "op9_sentence_spans": sentence_spans.ORACLE,
}
