"""TF-IDF over blocking texts and cosine top-k over blocks of records (pairs.py).

Terms are runs of two or more word characters (and, if asked, pairs of neighbours). A term stays if two records or
more, and at most nine tenths, of the indexed sources have it. Weight: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), each
record scaled to length 1. Cosines are rounded to nine places before ranking, so that the order of a sum decides no
tie; ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators import pairs
from kindred.storage import materialize, release

MIN_DF, MAX_SHARE = 2, 0.90


def term_counts(records: DataFrame, ngrams: int = 1) -> DataFrame:
    """source, rid, term, tf."""
    words = F.regexp_extract_all("blocking_text", F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    df = records.select("source", "rid", words.alias("w"))
    terms = F.col("w")
    if ngrams == 2:
        pairs = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(F.col("w"), i + 1)))
        terms = F.concat("w", pairs)
    return df.select("source", "rid", F.explode(terms).alias("term")).groupBy("source", "rid", "term").agg(F.count("*").alias("tf"))


def fit(counts: DataFrame, n: int) -> DataFrame:
    """term, idf of the indexed sources' n records."""
    df = counts.groupBy("term").agg(F.count("*").alias("df")).filter((F.col("df") >= MIN_DF) & (F.col("df") <= F.lit(MAX_SHARE) * n))
    return df.select("term", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def weights(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """source, rid, term, weight; terms that are not in idf are left out before scaling."""
    raw = counts.join(idf, "term").withColumn("raw", (F.log(F.col("tf").cast("double")) + 1.0) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("rid")))
    return raw.select("source", "rid", "term", (F.col("raw") / length).alias("weight"))


def record_weights(records: DataFrame, ngrams: int = 1) -> DataFrame:
    """Weights of all records; terms and frequencies come from S2 and S3."""
    counts = term_counts(records, ngrams)
    n = records.filter("source <> 'S1'").count()
    return weights(counts, fit(counts.filter("source <> 'S1'"), n))


def cosine_search(records: DataFrame, k: int, ngrams: int = 1, **scaled) -> pairs.Search:
    """The search of cosine_top, for pairs.united(). scaled: factor and plus of its scores there."""
    w = materialize(record_weights(records, ngrams), "weights")  # read from both sides
    keyed = w.withColumnRenamed("term", "key")
    own, others = (pairs.listed(keyed.filter(side), records) for side in ("source = 'S1'", "source <> 'S1'"))
    made = pairs.search(own, others, k, by_source=False, whole=False, **scaled)
    release(w)
    return made


def cosine_top(records: DataFrame, k: int, ngrams: int = 1) -> DataFrame:
    """source1_entity_id, candidate_entity_id, candidate_source, cosine: the k best of S2 and S3 together, above 0."""
    return pairs.found(cosine_search(records, k, ngrams)).withColumnRenamed("score", "cosine")
