"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldlens.llm import (bwt, filter_audit, hmm, html_text, language, lexical, mixing, ngram_join, rp_forest, substring,
                           tiling, toxicity, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substring.substring_dedup_query,
    "op2_mix_sources": mixing.mix_sources_query,
    "op3_language_id": language.language_id_query,
    "page_language": language.page_language_query,
    "op4_toxicity": toxicity.toxicity_query,
    "op6_hmm_score": hmm.lm_score_query,
    "op5_ngram_jaccard_join": ngram_join.jaccard_join_query,
    "op8_suffix_dedup": bwt.suffix_dedup_query,
    "op9_embedding_dedup": rp_forest.embedding_dedup_query,
    "op10_html_text": html_text.html_text_query,
    "op7_benchmark_decontamination": tiling.decontamination_query,
    "op11_ranked_search": lexical.ranked_search_query,
    "op12_warc": warc.warc_query,
    "op13_filter_audit": filter_audit.filter_audit_query,
}
ORACLE: dict[str, str] = {
    "op1_substring_dedup": substring.ORACLE,
    "op2_mix_sources": mixing.ORACLE,
    "op8_suffix_dedup": bwt.ORACLE,
    "op10_html_text": html_text.ORACLE,
    "op11_ranked_search": lexical.ORACLE,
    "op12_warc": warc.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
