"""Business records made from the table documents (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = [" Pvt. Ltd.", " Inc", " and Sons", ""]


def source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, source, entity_id, business_name, business_address, country, truth_key: one row for each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # thirteen words are wanted: the rest of a text is not split
    words = F.filter(F.split(F.ltrim(F.regexp_replace("text", r"^[ \t\r\n]+", "")), r"[ \t\r\n]+", 14), lambda w: w != "")
    df = docs.select("doc_id", "n_chars", "lang", F.md5("text").alias("truth_key"), words.alias("w"))
    source = F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"))
    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("doc_id") % 4 + 1).cast("int"))
    address = F.concat(
        F.array_join(F.slice("w", 6, 8), " "), F.lit(" Road"), F.when(F.col("doc_id") % 5 == 0, ", Opp. City Mall").otherwise(""),
        F.when(F.col("n_chars") % 7 != 0, F.concat(F.lit(", "), (10000 + (F.col("n_chars") * 7) % 90000).cast("string"))).otherwise(""),
    )
    return df.select(
        F.col("doc_id").alias("rid"), source.alias("source"), F.concat(source, F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        F.concat(F.array_join(F.slice("w", 1, 5), " "), suffix).alias("business_name"), address.alias("business_address"), F.col("lang").alias("country"), "truth_key",
    )


def truth_pairs(records: DataFrame) -> DataFrame:
    """source1_entity_id, matched_entity_id: records of the other sources with the same key."""
    left = records.filter("source = 'S1'").select("truth_key", F.col("entity_id").alias("source1_entity_id"))
    right = records.filter("source <> 'S1'").select("truth_key", F.col("entity_id").alias("matched_entity_id"))
    return left.join(right, "truth_key").select("source1_entity_id", "matched_entity_id")
