"""Tab-separated sources and sinks.

The order of rows is that of the scan: of one file, the order of its lines. Over several files Spark chooses the order
of files, so "first rows" and "the last row wins" are defined for single files alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

RECORD_COLUMNS = ["entity_id", "business_name", "business_address", "country"]
RECORDS = StructType([StructField(c, StringType()) for c in RECORD_COLUMNS])
TRUTH = StructType([StructField(c, StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def read_tsv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All columns as text; a quote within quotes is doubled; "NA" is text; an empty field is the empty string."""
    return spark.read.schema(schema).csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8").na.fill("")


def read_source(spark: SparkSession, path: str, limit: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """Records of one source; limit takes the first rows by position, columns prunes the scan."""
    df = read_tsv(spark, path, RECORDS)
    if limit is not None:
        df = read_rows(df, 0, limit)
    return df.select(*columns) if columns else df


def read_rows(df: DataFrame, start: int, end: int) -> DataFrame:
    """Rows [start, end) in the order of the scan."""
    numbered = df.withColumn("__at", F.monotonically_increasing_id())  # grows along the scan
    return numbered.orderBy("__at").offset(start).limit(max(0, end - start)).drop("__at")


def id_list(joined: Column) -> Column:
    """Distinct non-empty ids of a comma-separated list."""
    return F.array_distinct(F.filter(F.split(F.coalesce(joined, F.lit("")), ","), lambda x: x != ""))


def read_ground_truth(spark: SparkSession, path: str, only: DataFrame | None = None) -> DataFrame:
    """source1_entity_id, matched: of rows with the same id the last stays. only: ids (entity_id) to keep."""
    df = read_tsv(spark, path, TRUTH).withColumn("__at", F.monotonically_increasing_id())
    df = df.groupBy("source1_entity_id").agg(F.max_by("matched_entity_ids", "__at").alias("ids"))
    if only is not None:
        df = df.join(only.select(F.col("entity_id").alias("source1_entity_id")), "source1_entity_id", "left_semi")
    return df.select("source1_entity_id", id_list(F.col("ids")).alias("matched"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """entity_id: distinct first fields, without blank lines and the header."""
    line = F.trim(F.split("value", "\t")[0])
    return spark.read.text(path).select(line.alias("entity_id")).filter("entity_id NOT IN ('', 'entity_id', 'source1_entity_id')").distinct()


def id_lists(s1: DataFrame, lists: DataFrame, list_column: str, out: str) -> DataFrame:
    """One row for each S1 record (position order if s1 has `position`): its ids without repeats, comma-joined."""
    joined = s1.join(lists, s1["entity_id"] == lists["source1_entity_id"], "left")
    text = F.array_join(F.array_distinct(F.coalesce(F.col(list_column), F.array().cast("array<string>"))), ",")
    order = ["position"] if "position" in s1.columns else []
    return joined.select(s1["entity_id"].alias("source1_entity_id"), text.alias(out), *order)


def write_id_lists(df: DataFrame, path: str) -> None:
    """A single TSV file with header, in position order."""
    # sorted in the one task that writes: coalesce(1) after a global sort may take partitions in another order on a cluster
    one = df.repartition(1).sortWithinPartitions("position").drop("position") if "position" in df.columns else df.coalesce(1)
    one.write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="", quote="", encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_matches(s1: DataFrame, matches: DataFrame, path: str) -> None:
    write_id_lists(id_lists(s1, matches, "matched", "matched_entity_ids"), path)


def write_candidates(s1: DataFrame, candidates: DataFrame, path: str) -> None:
    write_id_lists(id_lists(s1, candidates, "candidates", "candidate_entity_ids"), path)
