"""Exact top-k search by inner product over a vector-approximation file.

Vectors of a length lie in blocks by a hash of their id. Within a block each dimension is cut at quantiles into up to
2**BITS cells, and a vector's approximation is its cell numbers, BITS bits each, packed. A cell's least and greatest
value bound what a query's component can give there, so sums over a table for each query bound every score.

1. Approximations alone are scanned: the k greatest lower bounds of each block and query lead to a lower bound of the
   kth score over all blocks.
2. Blocks are scanned again with that bound. Vectors whose upper bound lies below it are done with. Exact vectors of
   the others are read in the order of their bounds, a few at a time, until no bound left can beat the kth score read.

A block is one row of a table, with its exact vectors beside its approximations: these never travel to queries.
Queries go to each block of their length, in batches, so memory is bounded by a block and a batch. Each block returns
at most k rows for a query, none below the bound, and a window with a group limit merges them.

Vectors with a component too large for 64-bit products (wide ones) have no cells: within the same tasks they are
compared with every vector in whole numbers of any size, and scores are ranked by their exact values.

Defined cases: vectors that are null or hold null or non-finite components take no part; empty vectors score 0 with each
other; a score beyond 64 bits is shown as the nearest number of 64 bits; vectors are compared with those of equal length
only; rows with equal ids are candidates of their own, but a query's own id is none, and equal query ids are one query;
equal scores go to the smaller id; an empty table gives no rows. Columns other than the id and the vector are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.bitpack import pack, unpack
from kindred.storage import materialize, release

BITS = 4
VECTOR_BLOCK = 16384
QUERY_BLOCK = 256
READ_AT_ONCE = 128


def whole_vectors(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """vec_id, v: floor(scale * component), and raw of the vectors that take part. v is null for wide vectors, raw for others."""
    raw = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    usable = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), raw.alias("raw"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("raw").isNotNull()).filter(usable)
    # products of vectors within this sum up to less than 2**60
    most = F.sqrt(F.lit(2.0**60) / F.greatest(F.size("raw"), F.lit(1))) / 2
    narrow = F.forall("raw", lambda x: F.abs(x * float(scale)) < most)
    return rows.select("vec_id", F.when(narrow, F.transform("raw", lambda x: F.floor(x * float(scale)))).alias("v"), F.when(~narrow, F.col("raw")).alias("raw"))


def whole_number(x: float, scale: int) -> int:
    """floor(scale * x). From 2**53 on every double is whole, and the product is taken without rounding or overflow."""
    return int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale)


def rank_key(score: int) -> bytes:
    """Orders scores beyond 64 bits among themselves and against the limits that they are shown as."""
    if -(2**63) <= score < 2**63:
        return b"\x01"
    size = (abs(score).bit_length() + 7) // 8
    told = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return b"\x02" + told if score > 0 else b"\x00" + bytes(255 - x for x in told)


class Cells:
    """The cells of every dimension of a block: cut at quantiles, each from its least to its greatest value there."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, self.high = low, high  # (dimensions, cells)

    @classmethod
    def fit(cls, vectors: np.ndarray, bits: int) -> tuple["Cells", np.ndarray]:
        """The cells of vectors (n, dimensions), and the codes of the vectors."""
        n, dimensions = vectors.shape
        cells = 1 << bits
        low, high = np.zeros((dimensions, cells), np.int64), np.zeros((dimensions, cells), np.int64)
        codes = np.zeros(vectors.shape, np.uint8)
        for d in range(dimensions):
            ranked = np.sort(vectors[:, d])
            edges = np.unique(ranked[np.arange(1, cells) * n // cells])
            codes[:, d] = np.searchsorted(edges, vectors[:, d], side="right")
            at = np.searchsorted(ranked, edges)
            first, last = np.append(0, at), np.append(at, n) - 1
            there = first <= last
            low[d, : len(first)][there], high[d, : len(first)][there] = ranked[first[there]], ranked[last[there]]
        return cls(low, high), codes

    def _sums(self, codes: np.ndarray, queries: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        each = np.arange(codes.shape[1])
        ends = np.concatenate([first[each, codes], second[each, codes]], axis=1)
        return _product(np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1), ends)

    def lower(self, codes: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Lower bounds of the scores of every query with every vector (queries, n)."""
        return self._sums(codes, queries, self.low, self.high)

    def upper(self, codes: np.ndarray, queries: np.ndarray) -> np.ndarray:
        return self._sums(codes, queries, self.high, self.low)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, in the cheapest arithmetic that is exact."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else None
    if kind is None:
        return a @ b.T
    return a.astype(kind) @ b.T.astype(kind)


def least_of_best(lower: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """The k greatest lower bounds of each query, those of its own id left out (fewer if there are fewer)."""
    none = -np.inf if lower.dtype.kind == "f" else np.iinfo(np.int64).min
    lower = np.where(own, none, lower) if own.any() else lower
    n = lower.shape[1]
    return np.partition(lower, n - k, axis=1)[:, n - k :] if n > k else lower


def search_block(
    query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, ids: np.ndarray, codes: np.ndarray, exact: np.ndarray, cells: Cells, k: int, reads: list[int] | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its id, and ids and scores of the k best of the block (ties to the smaller id), none below its floor.

    reads gets the number of exact vectors read for each query."""
    upper = cells.upper(codes, queries)
    n = len(ids)
    for q, query_id in enumerate(query_ids.tolist()):
        bounds = upper[q]
        span = min(n, 4 * READ_AT_ONCE)
        ranked = _top(bounds, span)
        best_ids, best_scores, read = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while read < n:
            if read >= len(ranked):
                span = min(n, 4 * span)
                ranked = _top(bounds, span)
            able = bounds[ranked[read]]
            if able < floors[q] or len(best_scores) >= k and able < best_scores[k - 1]:
                break
            some = ranked[read : read + READ_AT_ONCE]
            some = some[bounds[some] >= floors[q]]
            read += len(some)
            some = some[ids[some] != query_id]
            all_ids = np.concatenate([best_ids, ids[some]])
            all_scores = np.concatenate([best_scores, exact[some] @ queries[q]])
            keep = np.lexsort((all_ids, -all_scores))[:k]
            best_ids, best_scores = all_ids[keep], all_scores[keep]
        if reads is not None:
            reads.append(read)
        there = best_scores >= floors[q]
        yield query_id, best_ids[there], best_scores[there]


def _top(bounds: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest bounds, highest first; the same beginning for every n."""
    if n >= len(bounds):
        return np.argsort(-bounds, kind="stable")
    edge = -np.partition(-bounds, n - 1)[n - 1]
    places = np.flatnonzero(bounds >= edge)
    return places[np.argsort(-bounds[places], kind="stable")]


def compare_all(query_ids: list[int], queries: np.ndarray, ids: np.ndarray, exact: np.ndarray, k: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """As search_block, by every score in whole numbers of any size (arrays of Python's)."""
    queries, best = queries.astype(object), [[] for _ in query_ids]
    for i in range(0, len(ids), QUERY_BLOCK):
        some, some_ids = exact[i : i + QUERY_BLOCK].astype(object), ids[i : i + QUERY_BLOCK].tolist()
        for j, query_id in enumerate(query_ids):
            scored = ((-s, n) for s, n in zip((some @ queries[j]).tolist(), some_ids) if n != query_id)
            best[j] = heapq.nsmallest(k, [*best[j], *scored])
    for query_id, found in zip(query_ids, best):
        yield query_id, [n for _, n in found], [-s for s, _ in found]


def _wide_matrix(column: pa.Array) -> np.ndarray:
    return np.array([[int(x) for x in text.split()] for text in column.to_pylist()], object)


def _blocks(whole: DataFrame, bits: int) -> DataFrame:
    """size, wide, block, ids, low, high, codes, exact: one row for each block of vectors."""
    n = max(1, whole.groupBy("size", "wide").count().agg(F.max("count")).first()[0] or 1)
    n_blocks = -(-n // VECTOR_BLOCK)
    kinds = "size long, wide boolean, block int, ids binary, low binary, high binary, codes binary, exact binary"
    schema = pa.schema([("size", pa.int64()), ("wide", pa.bool_()), ("block", pa.int32()), *((c, pa.binary()) for c in ("ids", "low", "high", "codes", "exact"))])

    def build(rows: pa.Table) -> pa.Table:
        size, wide, block = (rows.column(c)[0].as_py() for c in ("size", "wide", "block"))
        ids, told = np.asarray(rows.column("vec_id")).astype("<i8").tobytes(), rows.column("exact").to_pylist()
        if wide:
            parts = [b"", b"", b"", b"\n".join(told)]
        else:
            exact = (np.frombuffer(b"".join(told), "<i8") if size else np.zeros(0, np.int64)).reshape(len(told), size)
            cells, codes = Cells.fit(exact, bits)
            parts = [cells.low.tobytes(), cells.high.tobytes(), pack(codes.reshape(-1).astype(np.uint32), bits), exact.tobytes()]
        return pa.Table.from_pydict(dict(zip(schema.names, [[x] for x in (size, wide, block, ids, *parts)])), schema=schema)

    dealt = whole.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(n_blocks)).cast("int"))
    return dealt.groupBy("size", "wide", "block").applyInArrow(build, kinds)


def _encoded(whole: DataFrame, scale: int) -> DataFrame:
    """vec_id, size, wide, exact: whole numbers as bytes, or as text where they may be of any size."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact, sizes, wide = [], [], []
            for v, raw in zip(batch.column("v"), batch.column("raw")):
                wide.append(not v.is_valid)
                if wide[-1]:
                    sizes.append(len(raw))
                    exact.append(" ".join(str(whole_number(x, scale)) for x in raw.values.to_pylist()).encode())
                else:
                    x = np.asarray(v.values, np.int64)
                    sizes.append(len(x))
                    exact.append(x.astype("<i8").tobytes())
            columns = [batch.column("vec_id"), pa.array(sizes, pa.int64()), pa.array(wide, pa.bool_()), pa.array(exact, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "size", "wide", "exact"])

    return whole.mapInArrow(encode, "vec_id long, size long, wide boolean, exact binary")


class _Held:
    """A block as a task holds it."""

    def __init__(self, row: dict, bits: int):
        self.size, self.wide = row["size"], row["wide"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        n = len(self.ids)
        if self.wide:
            self.exact = None if row["exact"] is None else np.array([[int(x) for x in line.split()] for line in row["exact"].split(b"\n")], object).reshape(n, self.size)
        else:
            self.cells = Cells(*(np.frombuffer(row[c], np.int64).reshape(self.size, -1) if self.size else np.zeros((0, 1), np.int64) for c in ("low", "high")))
            self.codes = (unpack(row["codes"], n * self.size, bits).astype(np.int64) if self.size else np.zeros(0, np.int64)).reshape(n, self.size)
            self.exact = None if row["exact"] is None else (np.frombuffer(row["exact"], "<i8") if row["exact"] else np.zeros(0, np.int64)).reshape(n, self.size)


def _meetings(blocks: DataFrame, asked: DataFrame, columns: list[str], work, kinds: str, bits: int) -> DataFrame:
    """work(block, queries) for every block and batches of the queries of its length: blocks come first, queries after."""
    names = ["ids", "low", "high", "codes", "exact"]
    shown = [F.col(c) if c in columns else F.lit(None).cast("binary").alias(c) for c in names]
    there = blocks.select("size", "wide", "block", F.lit(0).alias("turn"), *shown, F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("boolean").alias("query_wide"),
                          F.lit(None).cast("binary").alias("query"), F.lit(None).cast("long").alias("floor"))
    # a row for each query and block of its length: the query set against all rows, in blocks
    sent = asked.join(blocks.select("size", "wide", "block"), "size")
    sent = sent.select("size", "wide", "block", F.lit(1).alias("turn"), *[F.lit(None).cast("binary").alias(c) for c in names], "query_id", "query_wide", "query", "floor")
    keys = ["size", "wide", "block"]
    rows = there.union(sent).repartition(*keys).sortWithinPartitions(*keys, "turn", "query_id")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, queries = None, []
        for batch in batches:
            turns = np.asarray(batch.column("turn"))
            cuts = [0, *np.flatnonzero(turns == 0).tolist(), len(turns)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b and turns[a] == 0:
                    held = _Held(batch.slice(a, 1).to_pylist()[0], bits)
                    a += 1
                for i in range(a, b, QUERY_BLOCK):
                    queries = batch.slice(i, min(QUERY_BLOCK, b - i))
                    yield from work(held, queries)

    return rows.mapInArrow(meet, kinds)


def _narrow(queries: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and floors of the queries that are not wide."""
    some = queries.filter(pa.compute.invert(queries.column("query_wide")))
    floors = np.asarray(pa.compute.fill_null(some.column("floor"), np.iinfo(np.int64).min))
    told = b"".join(some.column("query").to_pylist())
    return np.asarray(some.column("query_id")), (np.frombuffer(told, "<i8") if told else np.zeros(0, np.int64)).reshape(some.num_rows, size), floors


def top_k(vectors: DataFrame, is_query: Column, k: int, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 64, bits: int = BITS) -> DataFrame:
    """query_id, rank, vec_id, score for each row where is_query (a condition on vec_id) holds."""
    stored = materialize(_encoded(whole_vectors(vectors, id_column, vector_column, scale), scale), "vectors")
    blocks = materialize(_blocks(stored, bits), "vafile")
    asked = stored.filter(is_query).dropDuplicates(["vec_id"])
    asked = materialize(asked.select(F.col("vec_id").alias("query_id"), "size", F.col("wide").alias("query_wide"), F.col("exact").alias("query")), "queries")
    release(stored)

    def approximate(held: _Held, queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, asked, _ = _narrow(queries, held.size)
        if held.wide or not len(ids):
            return
        best = least_of_best(held.cells.lower(held.codes, asked), ids[:, None] == held.ids[None, :], k)
        rows, flat = np.repeat(np.arange(len(ids)), best.shape[1]), best.reshape(-1)
        able = np.isfinite(flat) if flat.dtype.kind == "f" else flat > np.iinfo(np.int64).min
        rows, flat = rows[able], flat[able]
        yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(flat.astype(np.int64))], names=["query_id", "lower"])

    no_floor = asked.withColumn("floor", F.lit(None).cast("long"))
    lowers = _meetings(blocks, no_floor, ["ids", "low", "high", "codes"], approximate, "query_id long, lower long", bits)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("lower").desc()))
    floors = lowers.withColumn("place", place).filter(F.col("place") <= k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("lower").alias("floor"))
    floors = floors.filter(F.col("n") == k).select("query_id", "floor")
    floored = materialize(asked.join(floors, "query_id", "left"), "floors")

    def exact(held: _Held, queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        got = []  # parts of the answer: query ids, ids and scores; scores in lists may be of any size
        ids, vectors, floors = _narrow(queries, held.size)
        if not held.wide and len(ids):
            got += search_block(ids, vectors, floors, held.ids, held.codes, held.exact, held.cells, k)
        elif held.wide and len(ids):
            got += compare_all(ids.tolist(), vectors, held.ids, held.exact, k)
        wide = queries.filter(queries.column("query_wide"))
        if wide.num_rows:
            got += compare_all(wide.column("query_id").to_pylist(), _wide_matrix(wide.column("query")), held.ids, held.exact, k)
        if not got:
            return
        found = np.concatenate([np.asarray(g[1], np.int64) for g in got])
        within = [np.asarray(g[2]) if isinstance(g[2], np.ndarray) else np.array([min(max(s, -(2**63)), 2**63 - 1) for s in g[2]], np.int64) for g in got]
        ranked = [x for g in got for x in ([b"\x01"] * len(g[2]) if isinstance(g[2], np.ndarray) else map(rank_key, g[2]))]
        columns = [pa.array(np.repeat([g[0] for g in got], [len(g[1]) for g in got]), pa.int64()), pa.array(found), pa.array(np.concatenate(within), pa.int64()), pa.array(ranked, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score", "key"])

    best = _meetings(blocks, floored, ["ids", "low", "high", "codes", "exact"], exact, "query_id long, vec_id long, score long, key binary", bits)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("key").desc(), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle_sql(every: int, k: int, scale: int = 64) -> str:
    """The same search by comparing all vectors, for DuckDB over the view embeddings."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i])), 0)::BIGINT AS score
    FROM v q, v d WHERE q.vec_id % {every} = 0 AND q.vec_id <> d.vec_id AND len(q.v) = len(d.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {k}"""
