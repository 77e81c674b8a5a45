"""Queries of the training-data operators and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import bpe, collocations, embedding_dedup, exact_dedup, html_extract, jaccard_join, language_id, lexical_search, line_dedup, packing, quality, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.query,
        "op2_embedding_dedup": embedding_dedup.query,
        "op3_line_dedup": line_dedup.query,
        "op4_html_extract": html_extract.query,
        "op5_quality": quality.query,
        "op6_ngram_jaccard_join": jaccard_join.query,
        "op7_byte_bpe": bpe.query,
        "op8_warc": warc.query,
        "op9_url_filter": url_filter.query,
        "op10_packing": packing.query,
        "op11_lexical_search": lexical_search.query,
        "op12_collocations": collocations.query,
        "op13_language_id": language_id.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.ORACLE_SQL,
        "op2_embedding_dedup": embedding_dedup.ORACLE_SQL,
        "op6_ngram_jaccard_join": jaccard_join.ORACLE_SQL,
        "op8_warc": warc.ORACLE_SQL,
        "op9_url_filter": url_filter.ORACLE_SQL,
        "op11_lexical_search": lexical_search.ORACLE_SQL,
        "op12_collocations": collocations.ORACLE_SQL,
    }
