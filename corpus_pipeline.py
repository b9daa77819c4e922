"""The corpus pipeline: each stage works on what its predecessor kept and is written before the next one reads it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrail.llm import chain_dedup, ngram_join, packing, pairwise_quality, quality_rules
from loomtrail.llm.common import Stages

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.kept_rows(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking predicts as good; it learns from the labels of the documents given."""
    model = pairwise_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return pairwise_quality.kept_rows(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies; rows without an id belong to no group and stay.

    Of rows that share an id the greatest text is compared, and all of them stay or go with it.
    """
    kept = ngram_join.ngram_join(docs).where("doc_id = component_id").select(F.col("doc_id").alias("__q_id"))
    return docs.join(kept, docs["doc_id"].cast("long") == F.col("__q_id"), "left_semi").unionByName(docs.where(docs["doc_id"].isNull()))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document holds, each cut from the text it was found in."""
    return chain_dedup.without(docs, chain_dedup.passages(docs))


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of tokens."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), digest=True)


STAGES: list[tuple[str, Stage]] = [("quality rules", rules), ("quality classifier", classifier), ("n-gram join", near_copies), ("substring dedup", passages), ("packing", windows)]
#: SQL cannot express the fit, the chains and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Stages(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stages.write(stage(spark, docs, sf_dir), str(k))
    return docs
