"""Labelled samples of a stated number of documents, and the optimiser that the models share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def remainder(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, limit: int) -> tuple[list[tuple[str, int]], float]:
    """Whole texts and labels of at most limit labelled documents for which learn holds, as many of each label as there are
    up to limit / 2: those with the lowest hashes of their ids, in that order, and the share of label 1 among all of them. Equal ids count once."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn)
    known = known.select(F.col("doc_id").cast("long"), (F.col(label) > 0).cast("int").alias("y")).groupBy("doc_id").agg(F.max("y").alias("y"))
    share = known.agg(F.avg("y")).first()[0]
    known = known.withColumn("h", F.xxhash64("doc_id", F.lit(11)))
    chosen = [known.filter(F.col("y") == y).orderBy("h", "doc_id").limit(limit // 2) for y in (0, 1)]
    chosen = F.broadcast(chosen[0].union(chosen[1]))  # limit rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(chosen, "doc_id")
    rows = texts.groupBy("h", "doc_id", "y").agg(F.min("text").alias("text")).collect()
    return [(r["text"], r["y"]) for r in sorted(rows, key=lambda r: (r["h"], r["doc_id"]))], float(share or 0.0)


def prior_shift(sample: list[tuple[str, int]], share: float) -> float:
    """What to add to the logit of a model fitted to equally many of both labels."""
    return float(np.log(share / (1 - share))) if 0 < share < 1 and sample else 0.0


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        clip = min(1.0, 5.0 / (norm + 1e-12))
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            m, v = self.m[k], self.v[k]
            m += 0.1 * (clip * g - m)
            v += 0.001 * ((clip * g) ** 2 - v)
            self.params[k] -= (rate * m / (np.sqrt(v) + 1e-8)).astype(self.params[k].dtype)


def softsign(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def auc(scores: np.ndarray, y: np.ndarray) -> float:
    """Chance that a row of label 1 scores above one of label 0 (ties count half)."""
    order = np.argsort(scores, kind="stable")
    _, inverse, counts = np.unique(scores[order], return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    positive = np.asarray(y)[order] == 1
    n1, n0 = int(positive.sum()), int((~positive).sum())
    return float((rank[positive].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)) if n1 and n0 else float("nan")
