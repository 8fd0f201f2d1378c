"""Checks of id-list files and of match results, as DataFrames of issues.

An issue row is (level, rule, source1_entity_id, detail). Errors fail a file, warnings do not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADERS = {"matching": ["source1_entity_id", "matched_entity_ids"], "candidates": ["source1_entity_id", "candidate_entity_ids"]}
ISSUES = "level string, rule string, source1_entity_id string, detail string"
EXAMPLES = 5


def _issue(df: DataFrame, rule: str, detail, level: str = "error", entity: str | None = "source1_entity_id") -> DataFrame:
    who = F.col(entity).cast("string") if entity else F.lit(None).cast("string")
    return df.select(F.lit(level).alias("level"), F.lit(rule).alias("rule"), who.alias("source1_entity_id"), detail.cast("string").alias("detail"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, at: lines in file order. at grows along the file, with a gap where Spark cuts it: numbered() counts."""
    return spark.read.text(path).withColumn("at", F.monotonically_increasing_id())


def numbered(lines: DataFrame) -> DataFrame:
    """lines with line, counted from 0 without a gap: the lines of all cuts before, and the place within its own."""
    cut = F.shiftright("at", 33)  # of monotonically_increasing_id: the partition; below it the row
    sizes = lines.groupBy(cut.alias("cut")).agg(F.count("*").alias("n"))  # a row for each cut of the file
    before = F.coalesce(F.sum("n").over(Window.orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("cut", before.alias("before")))
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return lines.withColumn("cut", cut).join(starts, "cut").withColumn("line", F.col("before") + place).drop("cut", "before")


def header_issues(lines: DataFrame, header: list[str]) -> DataFrame:
    """A missing or empty file, a header separated by commas, or another header: at most one row."""
    spark = lines.sparkSession
    first = lines.orderBy("at").limit(1).collect()
    if not first or not first[0]["value"].strip():
        rows = [("error", "empty_file", None, "no header line")]
    else:
        line = first[0]["value"].lstrip("﻿").rstrip("\r\n")
        names = [x.strip().lower() for x in line.split("\t")]
        if "\t" not in line and "," in line:
            rows = [("error", "comma_separated", None, line)]
        elif names != header:
            rows = [("error", "header_mismatch", None, line)]
        else:
            rows = []
    return spark.createDataFrame(rows, ISSUES)


def parse_lines(lines: DataFrame) -> DataFrame:
    """at, source1_entity_id, ids, ok (has a tab) of the non-blank lines after the first."""
    start = lines.agg(F.min("at").alias("start"))
    body = lines.join(F.broadcast(start), F.col("at") > F.col("start")).filter(F.trim(F.regexp_replace("value", r"\s", "")) != "")
    parts = F.split("value", "\t", 2)
    listed = F.coalesce(F.get(parts, 1), F.lit(""))
    ids = F.when(listed == "", F.array().cast("array<string>")).otherwise(F.split(listed, ","))
    return body.select("at", F.trim(parts[0]).alias("source1_entity_id"), ids.alias("ids"), F.contains("value", F.lit("\t")).alias("ok"))


def id_list_issues(rows: DataFrame, required: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """rows: at, source1_entity_id, ids, ok. required, targets: entity_id of S1, and of S2 and S3."""
    good = rows.filter("ok")
    each = good.select("source1_entity_id", F.explode("ids").alias("id"))
    found = [
        _issue(rows.filter("NOT ok"), "no_tab", F.col("source1_entity_id"), entity=None),
        _issue(good.groupBy("source1_entity_id").agg(F.count("*").alias("n")).filter("n > 1"), "duplicate_row", F.col("n")),
        _issue(good.filter(F.size("ids") != F.size(F.array_distinct("ids"))), "duplicate_id", F.array_join("ids", ",")),
        _issue(each.filter(F.startswith("id", F.lit("S1-"))), "self_match", F.col("id")),
        _issue(each.filter(~F.startswith("id", F.lit("S1-")) & ~F.startswith("id", F.lit("S2-")) & ~F.startswith("id", F.lit("S3-"))), "wrong_prefix", F.col("id")),
    ]
    if targets is not None:
        known = targets.select(F.col("entity_id").alias("id")).distinct()
        listed = each.filter(F.startswith("id", F.lit("S2-")) | F.startswith("id", F.lit("S3-")))
        found.append(_issue(listed.join(known, "id", "left_anti"), "unknown_id", F.col("id")))
    if required is not None:
        ids = required.select(F.col("entity_id").alias("source1_entity_id")).distinct()
        have = good.select("source1_entity_id").distinct()
        found.append(_issue(ids.join(have, "source1_entity_id", "left_anti"), "missing_row", F.col("source1_entity_id")))
        found.append(_issue(have.join(ids, "source1_entity_id", "left_anti"), "extra_row", F.col("source1_entity_id")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def last_lists(rows: DataFrame) -> DataFrame:
    """The list of each id; of several rows the last counts."""
    return rows.filter("ok").groupBy("source1_entity_id").agg(F.max_by("ids", "at").alias("ids"))


def subset_issues(matches: DataFrame, candidates: DataFrame, level: str = "warning") -> DataFrame:
    """Matches that are no candidates of their record."""
    m = last_lists(matches).select("source1_entity_id", F.explode(F.array_distinct("ids")).alias("id"))
    c = last_lists(candidates).select("source1_entity_id", F.explode(F.array_distinct("ids")).alias("id")).distinct()
    return _issue(m.join(c, ["source1_entity_id", "id"], "left_anti"), "not_a_candidate", F.col("id"), level)


def row_stats(rows: DataFrame) -> DataFrame:
    return rows.filter("ok").agg(F.count("*").alias("n_rows"), F.count_if(F.size("ids") == 0).alias("n_empty"), F.count_if(F.size("ids") > 0).alias("n_non_empty"))


def summary(issues: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """level, rule, n and the first examples by name. Issues are counted by aggregates; a group limit keeps the examples
    alone within each task, so no task gathers the issues of a rule."""
    named = issues.withColumn("shown", F.coalesce("source1_entity_id", "detail")).groupBy("level", "rule", "shown").agg(F.count("*").alias("n"))
    counts = named.groupBy("level", "rule").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("level", "rule").orderBy("shown"))
    few = named.select("level", "rule", "shown").withColumn("r", place).filter(F.col("r") <= examples)
    few = few.groupBy("level", "rule").agg(F.array_sort(F.collect_list("shown")).alias("examples"))
    return counts.join(few, ["level", "rule"])


def validate_files(spark: SparkSession, matching: str, candidates: str | None = None, required: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """All issues of the files of one run; what is not there to check against is a warning. A file with bytes that are
    not UTF-8 is not read any further."""
    notes: list[tuple] = []
    lists, out = {}, []
    for kind, path in (("matching", matching), ("candidates", candidates)):
        if path is None or not exists(spark, path):
            notes.append(("error" if kind == "matching" else "warning", "missing_file", None, f"{kind}: {path}"))
            continue
        lines = read_lines(spark, path)
        if not lines.filter(~F.is_valid_utf8("value")).isEmpty():
            notes.append(("error", "not_utf8", None, f"{kind}: {path}"))
            continue
        head = header_issues(lines, HEADERS[kind])
        if not head.isEmpty():
            out.append(head)
            continue
        lists[kind] = parse_lines(lines)
        out.append(id_list_issues(lists[kind], required, targets))
    if targets is None:
        notes.append(("warning", "ids_unchecked", None, "no target records given"))
    if len(lists) == 2:
        out.append(subset_issues(lists["matching"], lists["candidates"]))
    issues = spark.createDataFrame(notes, ISSUES)
    for more in out:
        issues = issues.unionByName(more)
    return issues


def passed(issues: DataFrame) -> bool:
    """Whether there is no error: exit code 0."""
    return issues.filter("level = 'error'").isEmpty()


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target))


def check_result(matches: DataFrame, candidates: DataFrame, records: DataFrame) -> DataFrame:
    """The check of a run's own frames (source1_entity_id, ids): here a match that is no candidate is an error."""
    as_rows = lambda df: df.select(F.lit(0).cast("long").alias("at"), "source1_entity_id", "ids", F.lit(True).alias("ok"))
    issues = id_list_issues(as_rows(matches), records.filter("source = 'S1'"), records.filter("source <> 'S1'"))
    return issues.unionByName(subset_issues(as_rows(matches), as_rows(candidates), "error"))
