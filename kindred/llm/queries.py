"""Queries opN_<name>: each operator with production parameters over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import bitpack, bytecnn, divergence, jaccard, mixing, packing, pii, toxicity, vafile, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op2_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_rule(_table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"), mixing.PRODUCTION).drop("text_hash")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages_through_warc(_table(spark, sf_dir, "pages"))


def op6_bytecnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytecnn.held_out_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.find_spans(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.packed_ids(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vafile": op1_vafile,
    "op2_divergence": op2_divergence,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_warc": op5_warc,
    "op6_bytecnn": op6_bytecnn,
    "op7_jaccard": op7_jaccard,
    "op8_pii": op8_pii,
    "op9_bitpack": op9_bitpack,
    "op10_packing": op10_packing,
}

ORACLES: dict[str, str] = {
    "op1_vafile": vafile.oracle_sql(20, 20),
    "op2_divergence": divergence.oracle_sql(),
    "op3_mixing": mixing.oracle_sql(),
    "op5_warc": warc.oracle_sql(),
}
