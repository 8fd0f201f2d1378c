"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters as the sum of two inputs: an embedding of the word (words that occur in fewer than MIN_DOCS training
documents share one) and the sum of embeddings of its character trigrams, edges included, over the root of their number. Words run through a forward and a backward gated recurrent layer over
windows of WINDOW words that overlap by WINDOW - STRIDE; attention weights the states of a window, and the window's
logit comes from their weighted sum. Windows cover the whole text; a document's score is its highest window's.
Gates use x / (1 + |x|) in place of the hyperbolic tangent, which costs a fraction and trains alike.

Training reads the whole texts of at most TRAIN_DOCS labelled documents, as many of each label as possible, draws windows
from anywhere in them, and the output bias is then moved to the share of label 1 among all labelled documents. The loss pools a document's windows by a soft maximum. Labels, lang, source and doc_id never enter a score.

Defined cases: null, empty and blank texts are one window without words, scored by the output bias alone; without
labels of both kinds every score is the share of label 1 among those there are (0 without any); rows that repeat
get equal scores; an empty table gives no rows. Columns other than doc_id and text are kept by ``score_texts`` and
ignored by the rest, whatever their names; one with the name that is asked for the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from kindred.llm import remembered, textscan
from kindred.llm.training import Adam, labelled_sample, prior_shift, remainder, softsign

WINDOW, STRIDE = 64, 48
KNOWN_WORDS, WORD_SIZE = 1 << 14, 8
MIN_DOCS = 3  # training documents that a word must occur in to have an embedding of its own
INDEX_BITS = 20
DROPPED = 0.25  # share of words that training reads by their trigrams alone
DECAY = 1e-4
TRIGRAM_BUCKETS, TRIGRAM_SIZE = 1 << 13, 6
HIDDEN = 8
TRAIN_DOCS = 3200
THRESHOLD = 0.3
HELD_OUT_MODULUS, HELD_OUT = 4, 2


class Words:
    """Network inputs of the words of several texts."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        raw = textscan.lower_ascii(raw)
        starts, ends, rows = textscan.words(raw, at)
        self.hash = textscan.span_hashes(raw, starts, ends)
        lengths = ends - starts
        self.first = np.cumsum(lengths) - lengths  # of each word among all trigrams
        place = np.arange(int(lengths.sum())) + np.repeat(starts - self.first, lengths)
        here = raw[place].astype(np.uint32)
        before, after = raw[np.maximum(place - 1, 0)].astype(np.uint32), raw[np.minimum(place + 1, max(0, len(raw) - 1))].astype(np.uint32)
        before[self.first] = 0x20
        after[self.first + lengths - 1] = 0x20
        mixed = ((before << np.uint32(16)) | (here << np.uint32(8)) | after) * np.uint32(0x9E3779B1)
        self.trigram = (mixed >> np.uint32(32 - 13)).astype(np.int64)
        self.scale = (1 / np.sqrt(np.maximum(lengths, 1))).astype(np.float32)
        self.bounds = np.searchsorted(rows, np.arange(len(at)))

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, first word and number of words of every window."""
        n = np.diff(self.bounds)
        count = np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE))
        row = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        return row, self.bounds[row] + k * STRIDE, np.clip(n[row] - k * STRIDE, 0, WINDOW)


class Network:
    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        f = lambda *s, scale: (r.normal(0, scale, s)).astype(np.float32)
        self.p = {
            "word": f(KNOWN_WORDS + 1, WORD_SIZE, scale=0.1), "trigram": f(TRIGRAM_BUCKETS, TRIGRAM_SIZE, scale=0.1),
            "in": f(WORD_SIZE + TRIGRAM_SIZE, 6 * HIDDEN, scale=0.4), "in_bias": np.zeros(6 * HIDDEN, np.float32),
            "uf": f(3 * HIDDEN, HIDDEN, scale=0.3), "ub": f(3 * HIDDEN, HIDDEN, scale=0.3),
            "look": f(2 * HIDDEN, scale=0.3), "out": f(2 * HIDDEN, scale=0.3), "bias": np.zeros(1, np.float32),
        }
        self.know(np.zeros(0, np.uint64))

    def know(self, hashes: np.ndarray) -> None:
        """Words with an embedding of their own; place 0 is that of all others."""
        self.known = np.concatenate([np.zeros(1, np.uint64), hashes[:KNOWN_WORDS]])
        self.index = np.zeros(1 << INDEX_BITS, np.int32)
        self.index[(self.known[1:] & np.uint64((1 << INDEX_BITS) - 1)).astype(np.int64)] = np.arange(1, len(self.known))

    def places(self, w: "Words") -> np.ndarray:
        found = self.index[(w.hash & np.uint64((1 << INDEX_BITS) - 1)).astype(np.int64)]
        return np.where(self.known[found] == w.hash, found, 0)

    def prepare(self) -> "Network":
        """Word embeddings already multiplied by the input layer: scoring only."""
        self.word_in = (self.p["word"] @ self.p["in"][:WORD_SIZE] + self.p["in_bias"]).astype(np.float32)
        return self

    def _trigram_sums(self, w: Words) -> np.ndarray:
        if not len(w.hash):
            return np.zeros((0, TRIGRAM_SIZE), np.float32)
        return np.add.reduceat(self.p["trigram"][w.trigram], w.first, axis=0) * w.scale[:, None]

    def inputs(self, w: Words) -> np.ndarray:
        """Gate inputs of both directions for each word, and a row of zeros at the end for places without a word."""
        x = self.word_in[self.places(w)] + self._trigram_sums(w) @ self.p["in"][WORD_SIZE:]
        return np.concatenate([x, np.zeros((1, 6 * HIDDEN), np.float32)])

    def _run(self, x: np.ndarray, u: np.ndarray, there: np.ndarray, step: int, keep: bool) -> tuple[np.ndarray, list]:
        """x: (T, 3 H, B) gate inputs; there: (T, B), 1 where there is a word. Returns states (T, H, B)."""
        steps = range(len(x)) if step > 0 else range(len(x) - 1, -1, -1)
        h = np.zeros((HIDDEN, x.shape[2]), np.float32)
        states, cache = np.empty((len(x), HIDDEN, x.shape[2]), np.float32), []
        for t in steps:
            g = u @ h
            gates = x[t, : 2 * HIDDEN] + g[: 2 * HIDDEN]
            gates = 0.5 + 0.5 * softsign(gates)
            z, r = gates[:HIDDEN], gates[HIDDEN:]
            n = softsign(x[t, 2 * HIDDEN :] + r * g[2 * HIDDEN :])
            new = n + z * (h - n)
            if step < 0:
                new *= there[t]  # empty places come first on the way back
            if keep:
                cache.append((t, h, g, z, r, n))
            h = states[t] = new
        return states, cache

    def forward(self, x: np.ndarray, there: np.ndarray, keep: bool = False):
        """x: (T, 6 H, B). Logits of B windows."""
        p = self.p
        f, cf = self._run(x[:, : 3 * HIDDEN], p["uf"], there, 1, keep)
        b, cb = self._run(x[:, 3 * HIDDEN :], p["ub"], there, -1, keep)
        look = np.einsum("thb,h->tb", f, p["look"][:HIDDEN]) + np.einsum("thb,h->tb", b, p["look"][HIDDEN:])
        weight = np.exp(np.minimum(look - look.max(0), 0)) * there
        weight /= np.maximum(weight.sum(0), 1e-9)
        context = np.concatenate([np.einsum("thb,tb->hb", f, weight), np.einsum("thb,tb->hb", b, weight)])
        logit = p["out"] @ context + p["bias"][0]
        return (logit, (f, b, cf, cb, weight, context)) if keep else logit

    def _back(self, d: np.ndarray, x: np.ndarray, u: np.ndarray, there: np.ndarray, step: int, cache: list) -> tuple[np.ndarray, np.ndarray]:
        dx, du, dh = np.zeros_like(x), np.zeros_like(u), np.zeros((HIDDEN, x.shape[2]), np.float32)
        slope = lambda s: (1 - np.abs(s)) ** 2
        for t, h, g, z, r, n in reversed(cache):
            dh = dh + d[t]
            if step < 0:
                dh = dh * there[t]
            dn, dz = dh * (1 - z), dh * (h - n)
            da_n = dn * slope(n)
            dr = da_n * g[2 * HIDDEN :]
            dx[t] = np.concatenate([dz * 0.5 * slope(2 * z - 1), dr * 0.5 * slope(2 * r - 1), da_n])
            dg = np.concatenate([dx[t, : 2 * HIDDEN], da_n * r])
            du += dg @ h.T
            dh = dh * z + u.T @ dg
        return dx, du

    def backward(self, d_logit: np.ndarray, x: np.ndarray, there: np.ndarray, kept: tuple) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        f, b, cf, cb, weight, context = kept
        p, h = self.p, HIDDEN
        grads = {"out": context @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_context = p["out"][:, None] * d_logit
        d_weight = np.einsum("thb,hb->tb", f, d_context[:h]) + np.einsum("thb,hb->tb", b, d_context[h:])
        d_look = weight * (d_weight - (weight * d_weight).sum(0))
        grads["look"] = np.concatenate([np.einsum("thb,tb->h", f, d_look), np.einsum("thb,tb->h", b, d_look)])
        df = weight[:, None] * d_context[:h] + d_look[:, None] * p["look"][:h, None]
        db = weight[:, None] * d_context[h:] + d_look[:, None] * p["look"][h:, None]
        dxf, grads["uf"] = self._back(df, x[:, : 3 * h], p["uf"], there, 1, cf)
        dxb, grads["ub"] = self._back(db, x[:, 3 * h :], p["ub"], there, -1, cb)
        return np.concatenate([dxf, dxb], axis=1), grads

    def scores(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One score for each text."""
        w = Words(raw, at)
        x = self.inputs(w)
        row, first, n = w.windows()
        logits = np.empty(len(row), np.float32)
        order = np.argsort(-n, kind="stable")  # windows of like length together
        for i in range(0, len(order), 1024):
            some = order[i : i + 1024]
            places, there = _places(first[some], n[some], len(x) - 1)
            logits[some] = self.forward(np.ascontiguousarray(x[places].transpose(0, 2, 1)), there)
        top = np.maximum.reduceat(logits, np.searchsorted(row, np.arange(len(at) - 1))) if len(row) else logits
        return 1 / (1 + np.exp(-top.astype(np.float64)))


def _places(first: np.ndarray, n: np.ndarray, nowhere: int) -> tuple[np.ndarray, np.ndarray]:
    """(T, B) word places and whether there is a word."""
    t = np.arange(max(1, int(n.max(initial=0))))[:, None]
    inside = t < n
    return np.where(inside, first + t, nowhere), inside.astype(np.float32)


def train(sample: list[tuple[str, int]], steps: int = 500, batch_docs: int = 32, windows_each: int = 8, rate: float = 0.015, seed: int = 1) -> Network:
    """Fit a network to texts and labels (both labels must occur)."""
    rng, net = np.random.default_rng(seed), Network(seed)
    texts = [t.encode() for t, _ in sample]
    seen, counts = np.unique(np.concatenate([np.unique(Words(np.frombuffer(t, np.uint8), np.array([0, len(t)])).hash) for t in texts]), return_counts=True)
    often = np.lexsort((seen, -counts))
    net.know(seen[often[: int((counts >= MIN_DOCS).sum())]])
    y = np.array([label for _, label in sample], np.float32)
    by_label = [np.flatnonzero(y == v) for v in (0, 1)]
    adam = Adam(net.p, rate)
    for k in range(steps):
        adam.rate = rate * min(1.0, 2.0 * (1 - k / steps))
        half = batch_docs // 2
        chosen = np.concatenate([rng.choice(i, half) for i in by_label])
        parts = [texts[i] for i in chosen]
        w = Words(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]))
        row, first, n = w.windows()
        lucky = np.argsort(row + rng.random(len(row)), kind="stable")
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        lucky = lucky[rank < windows_each]  # rows stay in order, windows within a row are drawn
        row, first, n = row[lucky], first[lucky], n[lucky]
        places, there = _places(first, n, len(w.hash))
        word = np.where(rng.random(len(w.hash)) < DROPPED, 0, net.places(w))
        sums = net._trigram_sums(w)
        features = np.concatenate([np.concatenate([net.p["word"][word], sums], axis=1), np.zeros((1, WORD_SIZE + TRIGRAM_SIZE), np.float32)])
        x = (features @ net.p["in"] + net.p["in_bias"])[places].transpose(0, 2, 1)
        x = np.ascontiguousarray(x)
        logit, kept = net.forward(x, there, keep=True)
        # soft maximum over the windows of a document: it sharpens as training goes on
        sharp = 0.5 + 2.5 * k / steps
        starts = np.searchsorted(row, np.arange(len(chosen)))
        top = np.maximum.reduceat(logit, starts)
        e = np.exp(sharp * (logit - top[row]))
        share = e / np.add.reduceat(e, starts)[row]
        pooled = np.add.reduceat(share * logit, starts)
        d_pooled = (1 / (1 + np.exp(-pooled)) - y[chosen]) / len(chosen)
        d_logit = (d_pooled[row] * share * (1 + sharp * (logit - pooled[row]))).astype(np.float32)
        dx, grads = net.backward(d_logit, x, there, kept)
        flat = np.zeros((len(features), 6 * HIDDEN), np.float32)
        np.add.at(flat, places.reshape(-1), dx.transpose(0, 2, 1).reshape(-1, 6 * HIDDEN))
        flat[-1] = 0
        used = np.unique(places)
        used = used[used < len(w.hash)]
        grads["in"], grads["in_bias"] = features.T @ flat, flat.sum(0)
        d = flat[used] @ net.p["in"].T
        grads["word"] = np.zeros_like(net.p["word"])
        np.add.at(grads["word"], word[used], d[:, :WORD_SIZE])
        last = np.append(w.first[1:], len(w.trigram))
        sizes = (last - w.first)[used]
        which = np.repeat(np.arange(len(used)), sizes)
        at = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(w.first[used], sizes)
        dt = d[:, WORD_SIZE:] * w.scale[used, None]
        grads["trigram"] = np.stack([np.bincount(w.trigram[at], dt[which, j], TRIGRAM_BUCKETS) for j in range(TRIGRAM_SIZE)], axis=1).astype(np.float32)
        for name in ("word", "trigram"):
            grads[name] += DECAY * net.p[name]
        adam.step(grads)
    return net.prepare()


def toxicity_scores(docs: DataFrame, labels: DataFrame, learn=None, limit: int = TRAIN_DOCS, name: str = "toxicity_score") -> DataFrame:
    """docs and a column (0 to 1), which replaces one of that name."""
    learn = remainder(HELD_OUT_MODULUS) != HELD_OUT if learn is None else learn
    return score_texts(docs, fit(docs, labels, "toxic", learn, limit, train), name)


def fit(docs: DataFrame, labels: DataFrame, label: str, learn, limit: int, trainer):
    """A model with scores(raw, at), or the share of label 1 where there are not both labels to learn from."""
    sample, share = labelled_sample(docs, labels, label, learn, limit)
    if not 0 < share < 1 or len({y for _, y in sample}) < 2:
        return share
    model = trainer(sample)
    model.p["bias"] += np.float32(prior_shift(sample, share))  # it was fitted to equally many of both labels
    return model


def score_texts(docs: DataFrame, model, name: str) -> DataFrame:
    """docs and a column, which replaces one of that name: the model's score of each whole text."""
    docs = docs.drop(name)
    if isinstance(model, float):
        return docs.withColumn(name, F.lit(model))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered.forget()
        for batch in batches:
            for part in textscan.slices(batch, "text", 1_000_000):
                scores = shared.value.scores(*textscan.text_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*part.schema.names, name])

    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.mapInArrow(score, schema)


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = toxicity_scores(rows, labels)
    held = F.coalesce(remainder(HELD_OUT_MODULUS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= THRESHOLD).cast("int").alias("predicted"))
