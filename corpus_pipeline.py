"""A corpus from raw documents: classify, deduplicate, decontaminate, mix, encode.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet
and read again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ambler.llm import common, decontaminate, mixing, near_dup, quality_net, token_files


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_net.accept(docs, common.table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dup.deduplicate(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in Huffman files; a row for each document read back."""
    return token_files.token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [("quality classifier", classify), ("near duplicates", deduplicate), ("decontamination", decontaminate_stage), ("mixing", mix), ("token files", encode)]

#: No SQL: the classifier's network and the Huffman files aren't expressible in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialise(docs, f"stage-{k}")
    return docs
