"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, exact_dedup, mixing, periodic, quality, repeats, secrets, sharding, simhash, templates, tool_calls, whitening
from .common import table


def op1_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op2_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.find_secrets(table(spark, sf_dir, "documents"))[0])


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return tool_calls.link_tool_calls(tool_calls.calls_of(conversations), tool_calls.results_of(conversations))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.language_scores(table(spark, sf_dir, "documents"))


def op6_maximal_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op7_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op9_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_patricia_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op11_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.judge(table(spark, sf_dir, "pages"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.collapse_runs(table(spark, sf_dir, "documents"), periodic.planted)


QUERIES = {f.__name__: f for f in (op1_extendible_sharding, op2_blob_ledger, op3_tool_calls, op4_quality, op5_context_mixing, op6_maximal_repeats, op7_positional_index, op8_gray_simhash, op9_prefix_bpe, op10_patricia_dedup, op11_path_templates, op12_whitening, op13_periodic_runs)}
ORACLES = {
    "op1_extendible_sharding": sharding.ORACLE, "op2_blob_ledger": secrets.ORACLE, "op3_tool_calls": tool_calls.ORACLE, "op7_positional_index": decontaminate.ORACLE,
    "op10_patricia_dedup": exact_dedup.ORACLE, "op11_path_templates": templates.ORACLE,
}
