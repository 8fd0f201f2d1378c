"""Labels, samples and splits. Rows are drawn by a hash of their id, so a draw does not depend on the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def draw(entity_id: Column, seed: int) -> Column:
    """The order in which ids are drawn."""
    return F.md5(F.concat(entity_id, F.lit(f":{seed}")))


def label_pairs(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """pairs with label 1 where truth (source1_entity_id, matched_entity_id) has them."""
    known = truth.select("source1_entity_id", F.col("matched_entity_id").alias("candidate_entity_id")).distinct().withColumn("label", F.lit(1))
    return pairs.join(known, ["source1_entity_id", "candidate_entity_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def group_split(ids: DataFrame, validation: float = 0.2, seed: int = 42) -> DataFrame:
    """ids (source1_entity_id) with is_validation; a pair follows its S1 id, so none is on both sides."""
    share = F.conv(F.substring(draw(F.col("source1_entity_id"), seed), 1, 6), 16, 10).cast("long")
    return ids.withColumn("is_validation", share < int(validation * 16**6))


def members(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return df.join(ids.select(column).distinct(), column, "left_semi")


def sample_ids(ids: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows of ids (entity_id), drawn without replacement."""
    return ids.orderBy(draw(F.col("entity_id"), seed), "entity_id").limit(n)


def sample_preserving(records: DataFrame, truth: DataFrame, n: int, n_other: int, seed: int = 42) -> dict[str, DataFrame]:
    """s1: up to n / 2 records with matches, the rest without. S2, S3: their true matches and others up to n_other each."""
    s1 = records.filter("source = 'S1'").select("entity_id")
    matched = truth.select(F.col("source1_entity_id").alias("entity_id")).distinct()
    with_matches = sample_ids(s1.join(matched, "entity_id", "left_semi"), n // 2, seed)
    without = sample_ids(s1.join(matched, "entity_id", "left_anti"), n, seed)
    ranked = with_matches.withColumn("first", F.lit(0)).union(without.withColumn("first", F.lit(1)))
    chosen = ranked.orderBy("first", draw(F.col("entity_id"), seed), "entity_id").limit(n).select("entity_id")
    wanted = truth.join(chosen.withColumnRenamed("entity_id", "source1_entity_id"), "source1_entity_id", "left_semi").select(F.col("matched_entity_id").alias("entity_id")).distinct()
    out = {"S1": chosen}
    for source in ("S2", "S3"):
        own = records.filter(F.col("source") == source).select("entity_id")
        ranked = own.join(wanted.withColumn("wanted", F.lit(1)), "entity_id", "left")
        must = ranked.filter("wanted = 1").select("entity_id")
        rest = ranked.filter("wanted IS NULL").select("entity_id")
        fill = rest.orderBy(draw(F.col("entity_id"), seed), "entity_id").limit(max(0, n_other - must.count()))
        out[source] = must.union(fill)
    return out
