"""Evaluation of predicted pairs against true ones; everything is a count per entity, then an average."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST, STEP, THRESHOLDS = 0.05, (0.05 + 0.01) - 0.05, 91  # the grid's own rounding decides ties at its steps


def f_half(precision: Column, recall: Column) -> Column:
    return F.when((precision == 0) & (recall == 0), 0.0).otherwise(1.25 * precision * recall / (0.25 * precision + recall))


def entity_f_half(hits: Column, predicted: Column, true: Column) -> Column:
    """Of one entity, from counts. Nothing true: 1 if nothing is predicted, else 0."""
    score = f_half(hits / F.nullif(predicted, F.lit(0)).cast("double"), hits / F.nullif(true, F.lit(0)).cast("double"))
    return F.when(true == 0, F.when(predicted == 0, 1.0).otherwise(0.0)).when(predicted == 0, 0.0).otherwise(score)


def entity_counts(predicted: DataFrame, truth: DataFrame, ids: DataFrame) -> DataFrame:
    """source1_entity_id, hits, n_predicted, n_true of every id that ids, predicted or truth has.

    predicted: source1_entity_id, candidate_entity_id; truth: source1_entity_id, matched_entity_id.
    """
    p = predicted.select("source1_entity_id", F.col("candidate_entity_id").alias("id")).distinct().withColumn("p", F.lit(1))
    t = truth.select("source1_entity_id", F.col("matched_entity_id").alias("id")).distinct().withColumn("t", F.lit(1))
    both = p.join(t, ["source1_entity_id", "id"], "full_outer").select("source1_entity_id", "p", "t")
    alone = ids.select("source1_entity_id", F.lit(None).cast("int").alias("p"), F.lit(None).cast("int").alias("t"))
    # a union, not a join with the counts: predicted is read once
    rows = both.union(alone).groupBy("source1_entity_id")
    return rows.agg(F.count(F.col("p") + F.col("t")).alias("hits"), F.count("p").alias("n_predicted"), F.count("t").alias("n_true"))


def macro_f_half(predicted: DataFrame, truth: DataFrame, ids: DataFrame) -> DataFrame:
    """macro_f_half over the ids of either side; 0 without any."""
    counts = entity_counts(predicted, truth, ids)
    return counts.agg(F.coalesce(F.avg(entity_f_half(F.col("hits"), F.col("n_predicted"), F.col("n_true"))), F.lit(0.0)).alias("macro_f_half"))


def recall_ceiling(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of true pairs among the candidates; 1 without any true pair."""
    c = candidates.select("source1_entity_id", F.col("candidate_entity_id").alias("matched_entity_id")).distinct().withColumn("hit", F.lit(1))
    found = truth.distinct().join(c, ["source1_entity_id", "matched_entity_id"], "left")
    share = F.count("hit") / F.nullif(F.count("*"), F.lit(0)).cast("double")
    return found.agg(F.coalesce(share, F.lit(1.0)).alias("recall_ceiling"), F.count("hit").alias("hits"), F.count("*").alias("true_pairs"))


def sweep(scored: DataFrame, truth: DataFrame, ids: DataFrame, first: float = FIRST, step: float = STEP, n: int = THRESHOLDS) -> DataFrame:
    """threshold, macro_f_half for each threshold, in one job. scored: source1_entity_id, candidate_entity_id, prob.

    A pair adds to every threshold up to its prob, so it is counted once, at the last such threshold; counts per
    entity and threshold follow by a sum over at most n rows of an entity.
    """
    grid = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(first) + i * F.lit(step))
    true = truth.select("source1_entity_id", F.col("matched_entity_id").alias("candidate_entity_id")).distinct().withColumn("t", F.lit(1))
    known = scored.select("source1_entity_id", "candidate_entity_id", "prob").join(true, ["source1_entity_id", "candidate_entity_id"], "left")
    last = F.size(F.filter(grid, lambda g: g <= F.col("prob")))
    per = known.select("source1_entity_id", "t", last.alias("last")).filter("last > 0").groupBy("source1_entity_id", "last").agg(F.count("*").alias("np"), F.count("t").alias("tp"))
    per = per.groupBy("source1_entity_id").agg(F.collect_list(F.struct("last", "np", "tp")).alias("steps"))  # at most n entries
    n_true = truth.distinct().groupBy("source1_entity_id").agg(F.count("*").alias("n_true"))
    base = ids.select("source1_entity_id").distinct().join(n_true, "source1_entity_id", "left").join(per, "source1_entity_id", "left")
    rows = base.select(F.coalesce("n_true", F.lit(0)).alias("n_true"), "steps", F.posexplode(grid).alias("i", "threshold"))
    above = lambda field: F.aggregate(F.filter(F.coalesce("steps", F.array().cast("array<struct<last:int,np:bigint,tp:bigint>>")), lambda s: s["last"] > F.col("i")), F.lit(0).cast("long"), lambda a, s: a + s[field])
    counted = rows.select("threshold", "n_true", above("tp").alias("tp"), above("np").alias("np"))
    scores = counted.select("threshold", entity_f_half(F.col("tp"), F.col("np"), F.col("n_true")).alias("f"))
    return scores.groupBy("threshold").agg(F.avg("f").alias("macro_f_half"))


def best_threshold(curve: DataFrame) -> tuple[float, float]:
    """The lowest of the best thresholds, 0.5 where no threshold scores above 0, and its score."""
    best = curve.orderBy(F.round("macro_f_half", 12).desc(), "threshold").first()
    return (best["threshold"], best["macro_f_half"]) if best and best["macro_f_half"] > 0 else (0.5, 0.0)


def empty_baseline(truth: DataFrame, ids: DataFrame) -> DataFrame:
    nothing = truth.limit(0).select("source1_entity_id", F.col("matched_entity_id").alias("candidate_entity_id"))
    return macro_f_half(nothing, truth, ids)


def run_stats(candidates: DataFrame, matches: DataFrame, s1: DataFrame) -> DataFrame:
    """Counts of one run in one row."""
    c = candidates.agg(F.count("*").alias("n_candidates"), F.count_distinct("source1_entity_id").alias("n_covered"))
    m = matches.agg(F.count("*").alias("n_matches"), F.count_distinct("source1_entity_id").alias("n_matched_entities"))
    n = s1.agg(F.count("*").alias("n_s1"))
    one = n.join(c).join(m)  # three rows in all
    return one.withColumn("n_singletons", F.col("n_s1") - F.col("n_matched_entities"))
