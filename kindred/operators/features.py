"""Fifteen features of candidate pairs: two joins to the records and a projection.

Pairs carry texts alone, and only those that the wanted features need: words and n-grams are cut again for each pair,
which costs time but keeps the exchange of pairs a fraction of what lists would make it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import similarity as S
from kindred.functions import text as T

FEATURES = [
    "block_score", "name_exact_norm", "name_lev_ratio", "name_token_jaccard", "name_token_sort_ratio", "name_char3gram_jaccard", "name_first_token_match",
    "addr_lev_ratio", "addr_token_jaccard", "addr_char3gram_jaccard", "postal_match", "postal_both_present", "same_country", "name_len_diff", "addr_len_diff",
]
_COLUMNS = ["name_norm", "name_toks", "addr_strip", "addr_toks", "postal", "country_norm"]  # in the order of "largest"


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def build_features(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """candidates with the feature columns (double). Of records with equal ids the largest by content counts."""
    lookup = records.select("entity_id", F.struct(*_COLUMNS).alias("r")).groupBy("entity_id").agg(F.max("r").alias("r"))
    # words hold no blank, so they come back as they were
    texts = [F.array_join(f"r.{c}", " ").alias(c) if c.endswith("_toks") else F.col(f"r.{c}").alias(c) for c in _COLUMNS]
    lookup = lookup.select("entity_id", *texts)
    side = lambda key, p: lookup.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in _COLUMNS])
    df = candidates.join(side("source1_entity_id", "a"), "source1_entity_id").join(side("candidate_entity_id", "b"), "candidate_entity_id")
    none = F.array().cast("array<string>")
    lists = {f"{p}_{c}": F.when(F.col(f"{p}_{c}") == "", none).otherwise(F.split(f"{p}_{c}", " ")) for p in "ab" for c in ("name_toks", "addr_toks")}
    grams = {f"{p}_{new}": T.char_ngrams(F.col(f"{p}_{c}")) for p in "ab" for new, c in (("name_3g", "name_norm"), ("addr_3g", "addr_strip"))}
    df = df.withColumns({**lists, **grams})
    both = lambda name: (F.col(f"a_{name}"), F.col(f"b_{name}"))
    first = lambda side: F.coalesce(F.get(F.col(f"{side}_name_toks"), 0), F.lit(""))
    (n1, n2), (p1, p2), (c1, c2) = both("name_norm"), both("postal"), both("country_norm")
    s1, s2 = both("addr_strip")
    made = {
        "name_exact_norm": _flag((n1 == n2) & (n1 != "")),
        "name_lev_ratio": S.levenshtein_ratio(n1, n2),
        "name_token_jaccard": S.jaccard(*both("name_toks")),
        "name_token_sort_ratio": S.token_sort_ratio(*both("name_toks")),
        "name_char3gram_jaccard": S.jaccard(*both("name_3g")),
        "name_first_token_match": S.prefix_match(first("a"), first("b"), 99),
        "addr_lev_ratio": S.levenshtein_ratio(s1, s2),
        "addr_token_jaccard": S.jaccard(*both("addr_toks")),
        "addr_char3gram_jaccard": S.jaccard(*both("addr_3g")),
        "postal_match": _flag(p1 == p2),
        "postal_both_present": _flag(p1.isNotNull() & p2.isNotNull()),
        "same_country": _flag((c1 != "") & (c1 == c2)),
        "name_len_diff": F.abs(F.length(n1) - F.length(n2)).cast("double"),
        "addr_len_diff": F.abs(F.length(s1) - F.length(s2)).cast("double"),
    }
    return df.select(*[F.col(c) for c in candidates.columns if c != "block_score"], F.col("block_score").cast("double").alias("block_score"), *[v.alias(k) for k, v in made.items()])
