"""The queries of this subpackage, and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    collocations,
    decontamination,
    hard_negatives,
    line_dedup,
    mixing,
    nearest,
    packing,
    secrets,
    sharding,
    simhash,
    token_files,
    topk,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixing_plan(table(spark, sf_dir, "documents"))
    return plan.select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken"
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = token_files.write_token_files(docs, WORD_TOKENIZER, end_id=2)
    return token_files.read_token_digests(spark, folder)


def op3_topk_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op4_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_nearest_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_decisions(table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digests(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def all_queries() -> dict[str, Query]:
    return {
        "op1_source_mixing": op1_source_mixing,
        "op2_token_files": op2_token_files,
        "op3_topk_products": op3_topk_products,
        "op4_uniform_shards": op4_uniform_shards,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_toxicity": op6_toxicity,
        "op7_nearest_cosine": op7_nearest_cosine,
        "op8_secret_scan": op8_secret_scan,
        "op9_simhash_groups": op9_simhash_groups,
        "op10_line_dedup": op10_line_dedup,
        "op11_decontamination": op11_decontamination,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_collocations": op13_collocations,
    }


def all_oracles() -> dict[str, str]:
    return {
        "op1_source_mixing": mixing.MIXING_SQL,
        "op3_topk_products": topk.TOPK_SQL,
        "op11_decontamination": decontamination.CONTAMINATION_SQL,
        "op12_hard_negatives": hard_negatives.HARD_NEGATIVES_SQL,
        "op13_collocations": collocations.COLLOCATIONS_SQL,
    }
