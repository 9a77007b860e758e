"""Queries that apply each operator to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import common, conversations, credentials, decontaminate, licenses, mixing, near_dup, quality_net, quality_rules, repeats, sharding, token_counts, token_files, toxicity


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(common.table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_net.score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(common.table(spark, sf_dir, "documents"), shards=16)


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link(common.table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digest(conversations.repair(conversations.damaged(common.table(spark, sf_dir, "conversations"))))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.digest(credentials.scan(common.table(spark, sf_dir, "documents")))


def op13_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.repeats(repeats.echoed(common.table(spark, sf_dir, "documents"))))


OPERATORS = (
    op1_license_scan,
    op2_quality_rules,
    op3_quality_classifier,
    op4_sharding,
    op5_near_dup,
    op6_mixing,
    op7_toxicity,
    op8_token_counts,
    op9_token_files,
    op10_decontamination,
    op11_conversation_repair,
    op12_secret_scan,
    op13_run_detection,
)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op11_conversation_repair": conversations.SQL, "op12_secret_scan": credentials.SQL}
