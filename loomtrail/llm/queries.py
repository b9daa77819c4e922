"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomtrail.llm import bpe, chain_dedup, divergence, near_vectors, ngram_join, packing, pairwise_quality, quality_rules, suffix_dedup, token_files, url_rules, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": token_files.op1_token_files,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_packing": packing.op6_packing,
    "op7_warc_audit": warc.op7_warc_audit,
    "op8_near_vectors": near_vectors.op8_near_vectors,
    "op9_chain_dedup": chain_dedup.op9_chain_dedup,
    "op10_pairwise_quality": pairwise_quality.op10_pairwise_quality,
    "op11_url_rules": url_rules.op11_url_rules,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE: dict[str, str] = {"op5_quality_rules": quality_rules.oracle(), "op7_warc_audit": warc.oracle(), "op11_url_rules": url_rules.oracle(), "op12_source_divergence": divergence.oracle()}
