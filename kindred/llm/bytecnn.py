"""Quality classifier: a convolutional network over bytes, trained in numpy.

A text's UTF-8 bytes are cut into chunks of CHUNK bytes that overlap by CHUNK - STRIDE and cover all of it. Filters
of WIDTH bytes run over every second byte of a chunk; each filter's highest response in a chunk is kept (max
pooling), and the mean and the maximum over a text's chunks of the rectified responses are combined into one
probability.

For scoring, a filter's response is the sum of WIDTH / 2 table entries, one for each pair of bytes: the tables hold the
products of byte embeddings and filters, so a whole text needs additions and maxima alone.

Training reads the whole texts of at most TRAIN_DOCS labelled documents (see ``training.labelled_sample``); each step
draws some chunks of each anew, from anywhere in it. Labels, lang, source and doc_id never enter a score.

Defined cases: null and empty texts are one chunk of zero bytes; without labels of both kinds every score is the
share of label 1 (0 without any); rows that repeat get equal scores; an empty table gives no rows. Columns other than
doc_id and text are kept by ``quality_scores`` and ignored by the rest, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.toxicity import fit, score_texts
from kindred.llm.training import Adam, remainder

CHUNK, STRIDE, WIDTH = 512, 384, 8
EMBEDDING, FILTERS = 8, 24
TRAIN_DOCS = 2400
THRESHOLD = 0.3
HELD_OUT_MODULUS, HELD_OUT = 5, 0
_PAIRS = STRIDE // 2
_HEAD = (CHUNK - WIDTH) // 2 + 1 - _PAIRS  # filter places of a chunk beyond its own stride


class Network:
    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        f = lambda *s, scale: r.normal(0, scale, s).astype(np.float32)
        self.p = {
            "byte": f(256, EMBEDDING, scale=0.5), "filter": f(WIDTH * EMBEDDING, FILTERS, scale=0.15), "shift": np.zeros(FILTERS, np.float32),
            "out": f(2 * FILTERS, scale=0.1), "bias": np.zeros(1, np.float32),
        }

    def prepare(self) -> "Network":
        """Responses of each filter to each pair of bytes at each even place: scoring only."""
        parts = self.p["filter"].reshape(WIDTH, EMBEDDING, FILTERS)
        single = [self.p["byte"] @ parts[k] for k in range(WIDTH)]
        self.tables = [(single[k][:, None] + single[k + 1][None]).reshape(-1, FILTERS).astype(np.float32) for k in range(0, WIDTH, 2)]
        return self

    def scores(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One score for each text."""
        n = np.diff(at)
        chunks = np.maximum(1, -(-(n - (CHUNK - STRIDE)) // STRIDE))
        first = np.concatenate([[0], np.cumsum(chunks + 1)])  # in strides; each text has one more for its last chunk
        data = np.zeros(int(first[-1]) * STRIDE + WIDTH, np.uint8)
        data[np.arange(len(raw)) + np.repeat(first[:-1] * STRIDE - at[:-1], n)] = raw
        pairs = data[0::2].astype(np.int32) * 256 + data[1::2]
        total = int(first[-1])
        heads, tops = np.empty((total, FILTERS), np.float32), np.empty((total, FILTERS), np.float32)
        step = 32  # strides at a time: what is held stays small
        for i in range(0, total, step):
            j = min(total, i + step)
            some = pairs[i * _PAIRS : j * _PAIRS + WIDTH // 2 - 1]
            m = (j - i) * _PAIRS
            y = self.tables[0][some[:m]]
            for k in range(1, WIDTH // 2):
                y += self.tables[k][some[k : k + m]]
            y = y.reshape(j - i, _PAIRS, FILTERS)
            heads[i:j] = y[:, :_HEAD].max(1)
            tops[i:j] = np.maximum(heads[i:j], y[:, _HEAD:].max(1))
        top = np.maximum(tops[:-1], heads[1:])
        own = np.ones(total, bool)
        own[first[1:] - 1] = False
        top = np.maximum(top[own[:-1]] + self.p["shift"], 0)
        starts = np.cumsum(chunks) - chunks
        pooled = np.concatenate([np.add.reduceat(top, starts) / chunks[:, None], np.maximum.reduceat(top, starts)], axis=1) if len(n) else np.zeros((0, 2 * FILTERS))
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return 1 / (1 + np.exp(-logit.astype(np.float64)))

    def loss_gradients(self, chunks: np.ndarray, row: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """chunks: (C, CHUNK) bytes; row: the text of each, in order."""
        p, n = self.p, len(y)
        e = p["byte"][chunks]
        shape = (len(chunks), (CHUNK - WIDTH) // 2 + 1, WIDTH, EMBEDDING)
        windows = np.lib.stride_tricks.as_strided(e, shape, (e.strides[0], 2 * e.strides[1], e.strides[1], e.strides[2])).reshape(*shape[:2], -1)
        z = windows @ p["filter"]
        best = z.argmax(1)
        c, f = np.arange(len(chunks))[:, None], np.arange(FILTERS)[None]
        raw = z[c, best, f] + p["shift"]
        top = np.maximum(raw, 0)
        starts = np.searchsorted(row, np.arange(n))
        count = np.diff(np.append(starts, len(row)))[:, None]
        mean, high = np.add.reduceat(top, starts) / count, np.maximum.reduceat(top, starts)
        pooled = np.concatenate([mean, high], axis=1)
        chance = 1 / (1 + np.exp(-(pooled @ p["out"] + p["bias"][0])))
        d = ((chance - y) / n).astype(np.float32)
        grads = {"out": pooled.T @ d, "bias": d.sum(keepdims=True)}
        d_pooled = d[:, None] * p["out"]
        is_high = top == high[row]
        d_top = d_pooled[row, :FILTERS] / count[row] + d_pooled[row, FILTERS:] * is_high / np.maximum(np.add.reduceat(is_high, starts)[row], 1)
        d_top *= raw > 0
        grads["shift"] = d_top.sum(0)
        won = windows[c, best]  # (C, FILTERS, WIDTH * EMBEDDING)
        grads["filter"] = np.einsum("cfw,cf->wf", won, d_top)
        d_won = d_top[:, :, None] * p["filter"].T[None]
        which = chunks[c[:, :, None], 2 * best[:, :, None] + np.arange(WIDTH)]
        grads["byte"] = np.zeros_like(p["byte"])
        np.add.at(grads["byte"], which.reshape(-1), d_won.reshape(-1, EMBEDDING))
        loss = -float(np.mean(y * np.log(chance + 1e-9) + (1 - y) * np.log(1 - chance + 1e-9)))
        return loss, grads


def train(sample: list[tuple[str, int]], steps: int = 600, batch_docs: int = 32, chunks_each: int = 5, rate: float = 0.01, seed: int = 1) -> Network:
    rng, net = np.random.default_rng(seed), Network(seed)
    texts = [np.frombuffer(t.encode(), np.uint8) for t, _ in sample]
    y = np.array([label for _, label in sample], np.float32)
    by_label = [np.flatnonzero(y == v) for v in (0, 1)]
    adam = Adam(net.p, rate)
    for k in range(steps):
        adam.rate = rate * min(1.0, 2.0 * (1 - k / steps))
        chosen = np.concatenate([rng.choice(i, batch_docs // 2) for i in by_label])
        chunks, row = [], []
        for i, doc in enumerate(chosen):
            text = texts[doc]
            n = max(1, -(-(len(text) - (CHUNK - STRIDE)) // STRIDE))
            for start in rng.choice(n, min(n, chunks_each), replace=False) * STRIDE:
                chunk = np.zeros(CHUNK, np.uint8)
                part = text[start : start + CHUNK]
                chunk[: len(part)] = part
                chunks.append(chunk)
                row.append(i)
        _, grads = net.loss_gradients(np.stack(chunks), np.array(row), y[chosen])
        adam.step(grads)
    return net.prepare()


def quality_scores(docs: DataFrame, labels: DataFrame, learn=None, limit: int = TRAIN_DOCS) -> DataFrame:
    """docs and a column quality_score (0 to 1), which replaces one of that name."""
    learn = remainder(HELD_OUT_MODULUS) != HELD_OUT if learn is None else learn
    return score_texts(docs, fit(docs, labels, "quality", learn, limit, train), "quality_score")


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = quality_scores(docs.select("doc_id", F.col("text").cast("string").alias("text")), labels)
    held = F.coalesce(remainder(HELD_OUT_MODULUS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
