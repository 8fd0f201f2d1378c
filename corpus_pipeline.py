"""A corpus from raw documents to packed sequences.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and works on all that the stage before
has kept. Every result is written to shared storage and read again as the next stage's documents.

Stages work on rows: equal rows, equal or missing ids, null or empty texts and further columns of any name are kept
apart and kept as they are, but where a stage's own line says otherwise. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import jaccard, mixing, packing, pii, toxicity
from kindred.storage import materialize, release


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs do not have, in whatever case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; null and empty texts are scored by the bias alone."""
    labels, score = spark.read.parquet(f"{sf_dir}/labels.parquet"), _free(docs, "toxicity_score")
    return toxicity.toxicity_scores(docs, labels, name=score).filter(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of rows with linked texts: the one with the smallest doc_id, then text, then other columns.

    Null, empty and blank texts are linked with nothing, so all of their rows stay; rows without an id take part.
    """
    return jaccard.first_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with spans of personal data masked; a null text stays null."""
    return pii.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, those of small sources up to twice, in the order of the mixture's blocks and places."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row: doc_id, piece, start, length, ids_crc32, sequence_id and offset. A null text is
    empty, and an empty one is a piece of one id."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Trained networks and tokenizers cannot be expressed in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
