"""Pattern packing: fill sequences of a fixed capacity by patterns fitted to the length histogram.

Documents longer than the capacity are cut into full pieces after a first, possibly shorter one. Lengths are put
into bins; patterns are the combinations of up to three bins that fill a sequence exactly; non-negative least
squares gives each pattern its repeat count against the histogram, rounded down. A pattern is realised on the exact
lengths: its last part, and whatever still fits, is the longest length left that fits. What no pattern takes is
packed longest first, each time with the longest length that still fits.

All of that happens on the histogram (at most ``capacity`` entries), so the driver's work and memory do not grow
with the corpus: it makes recipes (lengths of one sequence and how many sequences are like it). Pieces of a length
are numbered across partitions by counts per partition and length, and their number leads to recipe and place.

Defined cases: a null or empty text is a document of one id (the end id); repeated rows and equal doc_ids are
documents of their own; an empty table gives no rows; a null doc_id is kept. Columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm import textscan, tokens
from kindred.storage import materialize

CAPACITY = 2048
BINS = 128
MAX_ROUNDS = 1000

Recipe = tuple[tuple[int, ...], int]


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = MAX_ROUNDS, tolerance: float = 1e-6) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method on the normal equations."""
    gram, target = a.T @ a, a.T @ b
    gram[np.diag_indices_from(gram)] += 1e-9
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    enough = tolerance * max(1.0, float(np.abs(target).max(initial=0.0)))
    for _ in range(rounds):
        gradient = target - gram[:, passive] @ x[passive]
        gradient[passive] = -np.inf
        best = int(gradient.argmax())
        if gradient[best] <= enough:
            break
        passive[best] = True
        while passive.any():
            chosen = np.flatnonzero(passive)
            fit = np.linalg.solve(gram[np.ix_(chosen, chosen)], target[chosen])
            low = fit <= 0
            if not low.any():
                x[chosen] = fit
                break
            now = x[chosen]
            step = np.min(now[low] / np.maximum(now[low] - fit[low], 1e-300))
            moved = now + step * (fit - now)
            gone = low & (moved <= 1e-9 * max(1.0, float(now.max())))
            if not gone.any():
                gone = low
            x[chosen] = np.where(gone, 0.0, moved)
            passive[chosen[gone]] = False
    return x


def patterns(bins: int = BINS) -> list[tuple[int, ...]]:
    """Descending bins of two or three parts that add up to all bins. One part alone needs no pattern."""
    two = [(a, bins - a) for a in range(-(-bins // 2), bins)]
    three = [(a, b, bins - a - b) for a in range(-(-bins // 3), bins - 1) for b in range(-(-(bins - a) // 2), min(a, bins - a - 1) + 1)]
    return two + three


class _Stock:
    """How many pieces of each length are left; the longest length left up to a limit in near-constant time."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.tolist()
        self.below = list(range(len(self.counts)))

    def longest(self, limit: int, taken: Counter) -> int:
        """0 if there is none. taken: pieces already in the sequence being made."""
        x = self._find(max(0, limit))
        while x and self.counts[x] <= taken[x]:
            x = self._find(x - 1)
        return x

    def _find(self, x: int) -> int:
        trail = []
        while x and not self.counts[x]:
            if self.below[x] == x:
                self.below[x] = x - 1
            trail.append(x)
            x = self.below[x]
        for y in trail:
            self.below[y] = x
        return x

    def take(self, taken: Counter, most: int) -> int:
        n = min(most, *(self.counts[x] // k for x, k in taken.items()))
        for x, k in taken.items():
            self.counts[x] -= n * k
        return n


def recipes(histogram: dict[int, int], capacity: int = CAPACITY, bins: int = BINS) -> list[Recipe]:
    """Sequences (lengths, how many) that hold every piece of the histogram exactly once."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    made: list[Recipe] = []
    bins = min(bins, capacity)
    bin_of = -(-np.arange(capacity + 1) * bins // capacity)
    limit_of = [int(np.flatnonzero(bin_of == b).max()) for b in range(bins + 1)]
    stock = _Stock(counts)
    full = int(counts[capacity])
    if full:
        made.append(((capacity,), full))
        stock.counts[capacity] = 0
    wanted = np.bincount(bin_of, counts, bins + 1)[1:]
    wanted[-1] -= full
    shapes = patterns(bins)
    if wanted.sum() and shapes:
        a = np.zeros((bins, len(shapes)))
        for j, shape in enumerate(shapes):
            for part in shape:
                a[part - 1, j] += 1
        weight = np.sqrt(np.arange(1, bins + 1) / bins)[:, None]  # long pieces are harder to place later
        repeats = np.floor(nonnegative_least_squares(weight * a, weight[:, 0] * wanted) + 1e-6).astype(np.int64)
        for j in np.argsort(-repeats, kind="stable"):
            left = int(repeats[j])
            while left > 0:
                taken, room = Counter(), capacity
                for part in shapes[j][:-1]:
                    x = stock.longest(limit_of[part], taken)
                    if not x or bin_of[x] != part:
                        break
                    taken[x] += 1
                    room -= x
                else:
                    _fill(stock, taken, room)
                    n = stock.take(taken, left)
                    made.append((tuple(sorted(taken.elements(), reverse=True)), n))
                    left -= n
                    continue
                break
    while x := stock.longest(capacity, Counter()):
        taken = Counter([x])
        _fill(stock, taken, capacity - x)
        made.append((tuple(sorted(taken.elements(), reverse=True)), stock.take(taken, stock.counts[x])))
    return made


def _fill(stock: _Stock, taken: Counter, room: int) -> None:
    while room and (x := stock.longest(room, taken)):
        taken[x] += 1
        room -= x


def _slots(made: list[Recipe], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first number of each run of its pieces, that run's first sequence and the offset there."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    given: Counter = Counter()
    base = 0
    for lengths, n in made:
        offset = 0
        for x in lengths:
            runs.setdefault(x, []).append((given[x], base, offset))
            given[x] += n
            offset += x
        base += n
    return {x: tuple(np.array(r, np.int64).T) for x, r in runs.items()}


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the piece's number among those of its length in its partition."""
    vocabulary = vocabulary or tokens.default_vocabulary()
    kinds = pa.schema([(n, pa.int64()) for n in ("doc_id", "piece", "start", "length", "ids_crc32", "part", "number")])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, end = tokens.codec(vocabulary), np.array([tokens.END_ID], "<u4").tobytes()
        partition, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for some in textscan.slices(batch, "text", 1_000_000):
                rows = []
                for name, ids in zip(some.column("doc_id").to_pylist(), codec.encode([t or "" for t in some.column("text").to_pylist()])):
                    ids = memoryview(ids + end)
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        rows.append((name, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), partition, seen[length]))
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], schema=kinds)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(encode, ", ".join(f"{n} long" for n in kinds.names))


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, bins: int = BINS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, vocabulary, capacity), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    # a histogram of at most `capacity` rows, whatever the corpus
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(recipes(histogram, capacity, bins), capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    numbered = pieces.join(firsts, ["length", "part"]).withColumn("number", F.col("number") + F.col("first"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (np.asarray(batch.column(c)) for c in ("length", "number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                first, base, at = slots.value[int(length[rows[0]])]
                run = np.searchsorted(first, number[rows], side="right") - 1
                sequence[rows] = base[run] + number[rows] - first[run]
                offset[rows] = at[run]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    chosen = numbered.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "number")
    return chosen.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
