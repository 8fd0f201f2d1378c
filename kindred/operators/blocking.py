"""Candidate generation: postings, scores of pairs, top-k.

A disjunction of signals (shared name word, shared address word, same postal code, same name prefix) is one union of
postings (signal, key, weight). Pairs that share a key are scored and ranked where they are made (pairs.py): only
candidates leave a task. Ties in the top-k go to the smaller candidate id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators import pairs, tfidf


@dataclass(frozen=True)
class BlockingConfig:
    name_weight: int = 3
    address_weight: int = 1
    postal_weight: int = 5
    prefix_weight: int = 1
    prefix_column: str = "name_prefix3"
    df_cap: float | None = 0.95
    df_floor: int = 5
    score_scale: int = 1
    per_source: int = 20
    tfidf_top: int | None = None
    tfidf_ngrams: int = 1
    #: Without effect since nothing is broadcast; saved matchers name it.
    broadcast_bytes: int = 8 << 20


STANDARD = BlockingConfig()
NARROW = BlockingConfig(per_source=10)
HYBRID = BlockingConfig(postal_weight=10, prefix_column="first_prefix", df_cap=None, score_scale=10, per_source=100, tfidf_top=20)
WIDE = BlockingConfig(postal_weight=10, prefix_column="first_prefix", df_cap=None, score_scale=10, per_source=200, tfidf_top=50, tfidf_ngrams=2)

SIGNALS = {"name": "name_toks", "addr": "addr_toks", "postal": "postal", "prefix": None}


def postings(records: DataFrame, config: BlockingConfig = STANDARD, signals: tuple[str, ...] = ("name", "addr", "postal", "prefix")) -> DataFrame:
    """source, rid, signal, key, weight: one row for each distinct key of a record."""
    weights = {"name": config.name_weight, "addr": config.address_weight, "postal": config.postal_weight, "prefix": config.prefix_weight}
    keys = {
        "name": F.array_distinct("name_toks"), "addr": F.array_distinct("addr_toks"),
        "postal": F.array("postal"), "prefix": F.array(config.prefix_column),
    }
    # one pass over the records makes all signals
    made = [F.transform(keys[s], _entry(s, weights[s])) for s in signals]
    rows = records.select("source", "rid", F.explode(F.concat(*made)).alias("p")).select("source", "rid", "p.signal", "p.key", "p.weight")
    return rows.filter("key IS NOT NULL AND key <> ''")


def _entry(signal: str, weight: int):
    return lambda key: F.struct(F.lit(signal).alias("signal"), key.alias("key"), F.lit(weight).alias("weight"))


def document_frequency(post: DataFrame) -> DataFrame:
    """source, signal, key, df."""
    return post.groupBy("source", "signal", "key").agg(F.count("*").alias("df"))


def cap_frequency(post: DataFrame, records: DataFrame, config: BlockingConfig = STANDARD) -> DataFrame:
    """Without name and address keys that more than max(floor(cap * n), floor) records of their source have."""
    if config.df_cap is None:
        return post
    sizes = records.groupBy("source").agg(F.greatest(F.floor(F.count("*") * config.df_cap), F.lit(config.df_floor)).alias("most"))
    frequent = document_frequency(post.filter("signal IN ('name', 'addr')")).join(F.broadcast(sizes), "source").filter("df > most")
    return post.join(frequent.select("source", "signal", "key"), ["source", "signal", "key"], "left_anti")


def _sides(post: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys of S1 and of the other sources, the weights with the latter. post: postings of all sources."""
    keyed = post.withColumn("key", F.concat_ws(":", "signal", "key"))
    return pairs.listed(keyed.filter("source = 'S1'").withColumn("weight", F.lit(1)), records), pairs.listed(keyed.filter("source <> 'S1'"), records)


def block_scores(post: DataFrame, records: DataFrame, k: int | None = None) -> DataFrame:
    """source1_entity_id, candidate_entity_id, candidate_source, block_score: the sum of the weights of shared keys, of
    all pairs or of the k best of each S1 record and source. post: postings of all sources."""
    return pairs.pairs(*_sides(post, records), k).withColumnRenamed("score", "block_score")


def posting_index(records: DataFrame, config: BlockingConfig = STANDARD) -> DataFrame:
    """Capped postings of the other sources: write them once where several batches are matched against them."""
    others = records.filter("source <> 'S1'")
    return cap_frequency(postings(others, config), others, config)


def _all_postings(records: DataFrame, config: BlockingConfig, index: DataFrame | None) -> DataFrame:
    others = posting_index(records, config) if index is None else index
    return postings(records.filter("source = 'S1'"), config).unionByName(others)


def token_candidates(records: DataFrame, config: BlockingConfig = STANDARD, index: DataFrame | None = None) -> DataFrame:
    """source1_entity_id, candidate_entity_id, candidate_source, block_score. index: posting_index of the same records."""
    best = block_scores(_all_postings(records, config, index), records, config.per_source)
    return best.withColumn("block_score", F.col("block_score") * config.score_scale) if config.score_scale != 1 else best


def candidates(records: DataFrame, config: BlockingConfig = STANDARD, index: DataFrame | None = None) -> DataFrame:
    """Token candidates and, if configured, the best by TF-IDF; of equal pairs the highest score stays."""
    if config.tfidf_top is None:
        return token_candidates(records, config, index)
    by_key = pairs.search(*_sides(_all_postings(records, config, index), records), config.per_source, factor=config.score_scale)
    by_text = tfidf.cosine_search(records, config.tfidf_top, config.tfidf_ngrams, factor=100.0, plus=20)
    return pairs.united([by_key, by_text]).withColumnRenamed("score", "block_score")


def candidates_wide(found: DataFrame, s1: DataFrame) -> DataFrame:
    """source1_entity_id, candidate_entity_ids of every S1 record: best first, comma-joined, empty without any."""
    order = F.array_sort(F.collect_set(F.struct((-F.col("block_score")).alias("rank"), F.col("candidate_entity_id").alias("id"))))
    lists = found.groupBy("source1_entity_id").agg(F.array_join(F.transform(order, lambda x: x["id"]), ",").alias("ids"))
    ids = s1.select(F.col("entity_id").alias("source1_entity_id"))
    return ids.join(lists, "source1_entity_id", "left").select("source1_entity_id", F.coalesce("ids", F.lit("")).alias("candidate_entity_ids"))
