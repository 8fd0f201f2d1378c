"""Queries that go through files: tables written as TSV to the shared folder and read back by the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators import quality
from kindred.plans import oracle as O
from kindred.plans.catalog import query, records
from kindred.sources import tsv
from kindred.sources.fixtures import source_records, truth_pairs
from kindred.storage import new_path

_FIELDS = "coalesce(entity_id, '') AS entity_id, coalesce(business_name, '') AS business_name, coalesce(business_address, '') AS business_address, coalesce(country, '') AS country"


def _source_file(spark: SparkSession, sf_dir: str, source: str) -> str:
    """One file of a source's records, in the order of their numbers."""
    path = new_path(spark, "tsv")
    rows = source_records(spark, sf_dir).filter(F.col("source") == source).orderBy("rid").select(*tsv.RECORD_COLUMNS)
    rows.coalesce(1).write.csv(path, sep="\t", header=True, quote='"', escape='"', emptyValue="", encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


@query("tsv_scan", O.with_records(f"SELECT {_FIELDS} FROM raw WHERE source = 'S2'"))
def tsv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tsv.read_source(spark, _source_file(spark, sf_dir, "S2"))


@query("tsv_columns", O.with_records("SELECT coalesce(entity_id, '') AS entity_id, coalesce(country, '') AS country FROM raw WHERE source = 'S3'"))
def tsv_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tsv.read_source(spark, _source_file(spark, sf_dir, "S3"), columns=["entity_id", "country"])


@query("tsv_limit", O.with_records(f"SELECT {_FIELDS} FROM (SELECT * FROM raw WHERE source = 'S1' ORDER BY rid LIMIT 100)"))
def tsv_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tsv.read_source(spark, _source_file(spark, sf_dir, "S1"), limit=100)


@query("tsv_row_range", O.with_records(f"SELECT {_FIELDS} FROM (SELECT * FROM raw WHERE source = 'S1' ORDER BY rid LIMIT 90 OFFSET 30)"))
def tsv_row_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tsv.read_rows(tsv.read_source(spark, _source_file(spark, sf_dir, "S1")), 30, 120)


_LISTED = "SELECT source1_entity_id, list_sort(list(DISTINCT matched_entity_id)) AS ids FROM truth GROUP BY 1"
_WRITTEN = f"SELECT entity_id AS source1_entity_id, coalesce(array_to_string(ids, ','), '') AS ids FROM raw LEFT JOIN ({_LISTED}) ON source1_entity_id = entity_id WHERE source = 'S1'"


def _lists(spark: SparkSession, sf_dir: str, column: str) -> tuple[DataFrame, DataFrame]:
    """S1 with its position, and the true lists of ids."""
    r = source_records(spark, sf_dir)
    lists = truth_pairs(r).groupBy("source1_entity_id").agg(F.sort_array(F.collect_set("matched_entity_id")).alias(column))
    return r.filter("source = 'S1'").select("entity_id", F.col("rid").alias("position")), lists


def _matching_file(spark: SparkSession, sf_dir: str) -> str:
    path = new_path(spark, "matching")
    tsv.write_matches(*_lists(spark, sf_dir, "matched"), path)
    return path


@query("matching_sink", O.with_records(f"SELECT source1_entity_id, ids AS matched_entity_ids FROM ({_WRITTEN})", O.TRUTH))
def matching_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match lists written as a file and read as it is."""
    return tsv.read_tsv(spark, _matching_file(spark, sf_dir), tsv.TRUTH)


@query("candidate_sink", O.with_records(f"SELECT source1_entity_id, ids AS candidate_entity_ids FROM ({_WRITTEN})", O.TRUTH))
def candidate_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "candidates")
    tsv.write_candidates(*_lists(spark, sf_dir, "candidates"), path)
    return tsv.read_tsv(spark, path, tsv.TRUTH).withColumnRenamed("matched_entity_ids", "candidate_entity_ids")


@query("id_list_order", O.with_records("SELECT row_number() OVER (ORDER BY rid) AS line, entity_id AS source1_entity_id FROM raw WHERE source = 'S1'"))
def id_list_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the id-list file, numbered: rows stand in the order of positions."""
    lines = quality.numbered(quality.read_lines(spark, _matching_file(spark, sf_dir))).filter("line > 0")
    return lines.select("line", F.split("value", "\t")[0].alias("source1_entity_id"))


@query("truth_scan", O.with_records(f"SELECT source1_entity_id, ids AS matched_entity_ids FROM ({_WRITTEN})", O.TRUTH))
def truth_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The truth reader over a file of lists, empty ones among them."""
    found = tsv.read_ground_truth(spark, _matching_file(spark, sf_dir))
    return found.select("source1_entity_id", F.array_join(F.sort_array("matched"), ",").alias("matched_entity_ids"))


@query("truth_scan_only", O.with_records(f"SELECT source1_entity_id, ids AS matched_entity_ids FROM ({_WRITTEN}) JOIN raw ON entity_id = source1_entity_id WHERE rid % 2 = 0", O.TRUTH))
def truth_scan_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = source_records(spark, sf_dir).filter("source = 'S1' AND rid % 2 = 0").select("entity_id")
    found = tsv.read_ground_truth(spark, _matching_file(spark, sf_dir), only=some)
    return found.select("source1_entity_id", F.array_join(F.sort_array("matched"), ",").alias("matched_entity_ids"))


@query("id_column", O.with_records("SELECT DISTINCT entity_id FROM raw WHERE source = 'S3'"))
def id_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tsv.read_ids(spark, _source_file(spark, sf_dir, "S3"))



def _file(spark: SparkSession, lines: list[str]) -> str:
    path = new_path(spark, "lines")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


@query("validate_headers", """SELECT * FROM (VALUES ('absent', 'error', 'missing_file'), ('empty', 'error', 'empty_file'), ('commas', 'error', 'comma_separated'),
    ('wrong', 'error', 'header_mismatch'), ('right', NULL, NULL)) AS t(kind, level, rule)""")  # fmt: skip
def validate_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File rules: a missing or empty file, commas for tabs, another header, and one without fault."""
    files = {
        "absent": new_path(spark, "absent"), "empty": _file(spark, [" "]), "commas": _file(spark, ["source1_entity_id,matched_entity_ids", "S1-1,S2-1"]),
        "wrong": _file(spark, ["source1_entity_id\tids", "S1-1\tS2-1"]), "right": _file(spark, ["source1_entity_id\tmatched_entity_ids", "S1-1\tS2-1"]),
    }
    out = None
    for kind, path in files.items():
        issues = quality.validate_files(spark, path).filter("level = 'error'").agg(F.min("level").alias("level"), F.min("rule").alias("rule"))
        issues = issues.select(F.lit(kind).alias("kind"), "level", "rule")
        out = issues if out is None else out.unionByName(issues)
    return out


@query("validate_encoding", "SELECT * FROM (VALUES ('ISO-8859-1', 'error', 'not_utf8'), ('UTF-8', NULL, NULL)) AS t(encoding, level, rule)")
def validate_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The true lists with an accented id, written in two encodings: the one that is not UTF-8 is an error."""
    s1, lists = _lists(spark, sf_dir, "matched")
    accented = lists.withColumn("matched", F.transform("matched", lambda x: F.concat(x, F.lit("\u00e9"))))
    rows = tsv.id_lists(s1, accented, "matched", "matched_entity_ids").drop("position")
    out = None
    for encoding in ("ISO-8859-1", "UTF-8"):
        path = new_path(spark, "matching")
        rows.coalesce(1).write.csv(path, sep="\t", header=True, emptyValue="", quote="", encoding=encoding)
        found = quality.validate_files(spark, path).filter("level = 'error'").agg(F.min("level").alias("level"), F.min("rule").alias("rule"))
        found = found.select(F.lit(encoding).alias("encoding"), "level", "rule")
        out = found if out is None else out.unionByName(found)
    return out


@query("validate_file", O.with_records(
    f"""SELECT 'error' AS level, 'no_tab' AS rule, NULL AS source1_entity_id, entity_id AS detail FROM raw WHERE source = 'S1' AND rid % 7 = 0 UNION ALL
    SELECT 'error', 'missing_row', entity_id, entity_id FROM raw WHERE source = 'S1' AND rid % 7 = 0 UNION ALL
    SELECT 'warning', 'missing_file', NULL, 'candidates: None' UNION ALL SELECT 'warning', 'ids_unchecked', NULL, 'no target records given'""",
))
def validate_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matching file in which some lines have no tab, checked without candidates and without target records."""
    s1 = source_records(spark, sf_dir).filter("source = 'S1'")
    body = s1.select("rid", F.when(F.col("rid") % 7 == 0, F.col("entity_id")).otherwise(F.concat("entity_id", F.lit("\t"))).alias("value"))
    path = new_path(spark, "lines")
    header = spark.createDataFrame([(-1, "source1_entity_id\tmatched_entity_ids")], "rid long, value string")
    header.union(body).repartition(1).sortWithinPartitions("rid").select("value").write.text(path)
    return quality.validate_files(spark, path, None, s1.select("entity_id")).select("level", "rule", "source1_entity_id", "detail")


@query("validate_result", O.with_records(
    """SELECT 'error' AS level, 'not_a_candidate' AS rule, source1_entity_id, matched_entity_id AS detail FROM (SELECT DISTINCT * FROM truth) JOIN raw ON entity_id = source1_entity_id WHERE rid % 2 = 0""", O.TRUTH,
))
def validate_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check of a run's own frames: every other record has lost its candidates."""
    s1, lists = _lists(spark, sf_dir, "ids")
    rows = s1.join(lists, s1["entity_id"] == lists["source1_entity_id"], "left")
    none = F.array().cast("array<string>")
    rows = rows.select(F.col("entity_id").alias("source1_entity_id"), "position", F.coalesce("ids", none).alias("ids"))
    found = rows.select("source1_entity_id", F.when(F.col("position") % 2 == 0, none).otherwise(F.col("ids")).alias("ids"))
    return quality.check_result(rows.select("source1_entity_id", "ids"), found, records(spark, sf_dir))
