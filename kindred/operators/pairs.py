"""Scores of pairs of S1 with the other sources, made where they are ranked: no pair is shuffled.

Records of the other sources form blocks in the order of their ids, each one row: its keys and, for each key, the places
of the records that have it. Records of S1 are dealt into chunks; a task holds one chunk and meets all blocks one after
another, with the best of each record so far; several searches follow each other there. A key that many records of a
block have is a row of numbers for the whole block, added at once; other keys are lists of places. All pairs are scored
and none is left out; ids come in order, so of equal scores the first found stays. Where all pairs are wanted, a pair leaves
Python as one number, and its ids are looked up in generated code.

What is shuffled are the records of S1 once and the blocks once for each chunk. Time grows with the product of both sides.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.storage import materialize, release

#: Records of the other sources in a block, and of S1 in a chunk.
BLOCK, CHUNK = 65_536, 8_192
#: The same where all pairs are wanted. Pairs come block by block, so a file's dictionary of ids holds what a few blocks
#: have: with long ones Parquet gives its dictionaries up and writes every id in full.
BLOCK_OF_ALL = 8_192
#: A key of more than this share of a block's records is a row for the whole block.
DENSE, DENSE_REAL = 1 / 64, 1 / 12  # whole numbers are bytes, others four of them
#: Columns whose greatest scores bound the kth.
COLUMNS = 2_048
#: Pairs of a row where all pairs are wanted: what one record adds comes on top.
PAIRS = 1 << 15
#: Bits of a pair's score and of its place in a block, as all pairs are packed.
SCORE_BITS, PLACE_BITS = 31, 16


def listed(post: DataFrame, records: DataFrame) -> DataFrame:
    """source, rid, entity_id, keys of each record with a key. post: source, rid, key, weight."""
    keys = post.groupBy("source", "rid").agg(F.collect_list(F.struct("key", F.col("weight").cast("double").alias("weight"))).alias("keys"))
    return keys.join(records.select("rid", "entity_id").dropDuplicates(["rid"]), "rid")


@dataclass(frozen=True)
class Search:
    """The k best others of each record of own, as pairs() tells; own and blocks are tables. united() takes
    floor(score * factor) + plus for a score.
    """

    own: DataFrame
    blocks: DataFrame
    n_own: int
    k: int | None
    by_source: bool = True
    whole: bool = True
    factor: float = 1.0
    plus: int = 0

    @property
    def told(self) -> tuple:
        """What a task has to know."""
        return self.k, self.by_source, self.whole, self.factor, self.plus


def search(own: DataFrame, others: DataFrame, k: int | None, by_source: bool = True, whole: bool = True, factor: float = 1.0, plus: int = 0) -> Search:
    """own, others: listed(). They are read here and not again."""
    own, others = materialize(own, "own"), materialize(others, "others")
    order = ["source", "entity_id"] if by_source else ["entity_id"]
    ranged = others.repartitionByRange(max(1, -(-others.count() // BLOCK)), *order).sortWithinPartitions(*order)
    most = BLOCK if k is not None else BLOCK_OF_ALL
    blocks = materialize(ranged.mapInArrow(lambda batches: _build(batches, by_source, most), "source string, first string, data binary"), "blocks")
    release(others)
    return Search(own, blocks, own.count(), k, by_source, whole, factor, plus)


def _dealt(searches: list[Search]) -> DataFrame:
    """Rows of chunks: records of S1 of the first search, its blocks, those of the second. An id of S1 is in one chunk."""
    n = max(s.n_own for s in searches)
    chunks = max(1, -(-n // CHUNK), min(searches[0].own.sparkSession.sparkContext.defaultParallelism, -(-n // 256)))
    empty = "cast(NULL AS {}) AS {}".format
    rows = None
    for i, s in enumerate(searches):
        asked = s.own.select(F.pmod(F.xxhash64("entity_id"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(2 * i).alias("turn"), "entity_id", "keys", F.expr(empty("string", "source")), F.expr(empty("string", "first")), F.expr(empty("binary", "data")))
        sent = s.blocks.select(
            F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(2 * i + 1).alias("turn"), F.expr(empty("string", "entity_id")),
            F.expr(empty("array<struct<key:string,weight:double>>", "keys")), F.col("source") if s.by_source else F.expr(empty("string", "source")), "first", "data",
        )
        both = asked.unionByName(sent)
        rows = both if rows is None else rows.unionByName(both)
    return rows.repartitionById(chunks, F.col("chunk")).sortWithinPartitions("turn", "source", "first")


def pairs(own: DataFrame, others: DataFrame, k: int | None, by_source: bool = True, whole: bool = True) -> DataFrame:
    """source1_entity_id, candidate_entity_id, candidate_source, score of the k best candidates of each record of own, of
    each source or (by_source false) of all together; of all pairs with a shared key if k is None. own, others: listed().

    The score of a pair is the sum of the products of both weights over shared keys. whole: weights are whole numbers;
    else scores are rounded to nine places before ranking, and those that round to 0 are left out.
    """
    return found(search(own, others, k, by_source, whole))


def found(s: Search) -> DataFrame:
    """The pairs of one search, see pairs()."""
    k, by_source, whole = s.told[:3]
    if k is None:
        return _unpacked(_dealt([s]).mapInArrow(_meet_all, "own array<string>, names array<string>, sources array<string>, packed array<bigint>"))
    kind = "int" if whole else "double"
    return _dealt([s]).mapInArrow(lambda batches: _meet(batches, k, by_source, whole), f"source1_entity_id string, candidate_entity_id string, candidate_source string, score {kind}")


def _unpacked(rows: DataFrame) -> DataFrame:
    """A row for each pair, see _all_pairs(). Between Python and the JVM a pair is one number; its ids are looked up in generated code."""
    place = F.shiftright("pair", SCORE_BITS).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return rows.select("own", "names", "sources", F.explode("packed").alias("pair")).select(
        F.get("own", F.shiftright("pair", SCORE_BITS + PLACE_BITS).cast("int")).alias("source1_entity_id"), F.get("names", place.cast("int")).alias("candidate_entity_id"),
        F.get("sources", F.when(F.size("sources") == 1, F.lit(0)).otherwise(place.cast("int"))).alias("candidate_source"),
        F.col("pair").bitwiseAND(F.lit((1 << SCORE_BITS) - 1)).cast("int").alias("score"),
    )


def united(searches: list[Search]) -> DataFrame:
    """source1_entity_id, candidate_entity_id, candidate_source, score of the pairs of all searches, each pair once with
    its greatest score. The task that holds a record of S1 makes all searches for it, so pairs are not shuffled for that.
    """
    told = [s.told for s in searches]
    return _dealt(searches).mapInArrow(lambda batches: _unite(batches, told), "source1_entity_id string, candidate_entity_id string, candidate_source string, score int")


def _build(batches: Iterator[pa.RecordBatch], by_source: bool, most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Blocks of consecutive records, of one source each if by_source, of equal sizes up to most."""
    batches = list(batches)  # some BLOCK records, by the sample of the range partitioning
    if not batches:
        return
    rows = pa.Table.from_batches(batches).combine_chunks()
    sources = np.asarray(rows.column("source").to_pylist(), object)
    cuts = [0, *(np.flatnonzero(sources[1:] != sources[:-1]) + 1).tolist(), rows.num_rows] if by_source else [0, rows.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        size = -(-(b - a) // -(-(b - a) // most))
        for i in range(a, b, size):
            part = rows.slice(i, min(size, b - i)).combine_chunks()
            names = part.column("entity_id").to_pylist()
            data = zlib.compress(pickle.dumps((names, part.column("source").to_pylist(), *_inverted(part.column("keys"))), protocol=5), 1)
            yield pa.RecordBatch.from_arrays([pa.array([str(sources[i])]), pa.array([names[0]]), pa.array([data], pa.binary())], names=["source", "first", "data"])


def _inverted(column: pa.ChunkedArray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Keys, where the list of each begins, places and weights. Weights of a key that a record has twice are added up."""
    lists = pa.concat_arrays(column.chunks)
    entries = lists.flatten()
    places = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
    coded = entries.field("key").dictionary_encode()
    codes, weights = np.asarray(coded.indices), np.asarray(entries.field("weight"))
    order = np.lexsort((places, codes))
    codes, places, weights = codes[order], places[order], weights[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (places[1:] != places[:-1])
    starts = np.flatnonzero(new)
    codes, places, weights = codes[starts], places[starts].astype(np.uint32), np.add.reduceat(weights, starts) if len(starts) else weights
    offsets = np.searchsorted(codes, np.arange(len(coded.dictionary) + 1))
    return coded.dictionary.to_pylist(), offsets, places, weights


class _Block:
    """A block as a task holds it."""

    def __init__(self, data: bytes, whole: bool):
        self.names, self.sources, keys, offsets, places, self.weights = pickle.loads(zlib.decompress(data))
        self.n, self.whole = len(self.names), whole
        self.offsets, self.places = offsets, places.astype(np.int64)
        self.where = dict(zip(keys, range(len(keys))))
        self.most = np.maximum.reduceat(self.weights, offsets[:-1]) if keys else np.zeros(0)
        self.held: dict[str, tuple | None] = {}  # of the keys that were asked for
        room = -(-self.n // COLUMNS) * COLUMNS
        kind = np.uint8 if whole else np.float32
        self.room, self.product = np.zeros(room, kind), np.zeros(self.n, kind)
        self.scores = self.room[: self.n]

    def hold(self, key: str) -> tuple | None:
        """row, places, weights there, the same in the type of the scores, the greatest, where the list begins. The row has the weights for
        the whole block, None where the key is too rare. Whole numbers are bytes, None where they don't fit."""
        i = self.where.get(key)
        if i is None:
            return None
        at, some = (x[self.offsets[i] : self.offsets[i + 1]] for x in (self.places, self.weights))
        row, few, most = None, None, self.most[i].item()
        if not self.whole or most <= 255:
            few = some.astype(self.scores.dtype)
            if len(at) > self.n * (DENSE if self.whole else DENSE_REAL):
                row = np.zeros(self.n, self.scores.dtype)
                row[at] = few
        return row, at, some, few, most, self.offsets[i].item()

    def known(self, keys: list[str], weights: list[float]) -> list[tuple]:
        """The weight and what hold() tells of each key of the block."""
        held, found = self.held, []
        for key, w in zip(keys, weights):
            if key not in held:
                held[key] = self.hold(key)
            if held[key] is not None:
                found.append((w, held[key]))
        return found

    def score(self, known: list[tuple]) -> np.ndarray:
        """Scores of all records of the block: in one byte each if they fit, or in 32 bits if they are no whole numbers."""
        if self.whole and sum(w * x[4] for w, x in known) > 255:
            scores = np.zeros(self.n, np.int64)
            for w, x in known:
                scores[x[1]] += (w * x[2]).astype(np.int64)
            return scores
        scores, kind, rare = self.scores, self.scores.dtype.type, []
        scores.fill(0)
        for w, x in known:
            if x[0] is None:
                rare.append((w, x))
            elif w == 1:
                np.add(scores, x[0], out=scores)
            else:
                np.multiply(x[0], kind(w), out=self.product)
                np.add(scores, self.product, out=scores)
        if rare:
            plus = np.concatenate([x[3] for _, x in rare])
            if any(w != 1 for w, _ in rare):
                plus *= np.repeat(np.array([w for w, _ in rare], kind), [len(x[1]) for _, x in rare])
            np.add.at(scores, np.concatenate([x[1] for _, x in rare]), plus)
        return scores

    def tops(self, scores: np.ndarray) -> np.ndarray:
        """The greatest score of each column: column i has the places i, i + COLUMNS, ..."""
        return (self.room if scores is self.scores else np.pad(scores, (0, len(self.room) - self.n))).reshape(-1, COLUMNS).max(axis=0)

    def above(self, scores: np.ndarray, tops: np.ndarray, bound: float) -> np.ndarray:
        """Places of scores above a bound, in order: only columns that reach it are read."""
        bound = scores.dtype.type(bound)
        columns = np.flatnonzero(tops > bound)
        if scores is not self.scores or 4 * len(columns) > COLUMNS:
            return np.flatnonzero(scores > bound)
        i, j = np.divmod(np.flatnonzero(self.room.reshape(-1, COLUMNS)[:, columns] > bound), max(1, len(columns)))
        return i * COLUMNS + columns[j]

    def whole_best(self, keys: list[str], weights: list[float], floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best above floor, of equal ones the first."""
        known = self.known(keys, weights)
        if sum(w * x[4] for w, x in known) <= floor:
            return _NONE
        scores = self.score(known)
        tops = self.tops(scores)
        if tops.max() <= floor:
            return _NONE
        edge = max(_kth(tops, k), int(floor) + 1)  # k records reach it, or it is the least that counts
        many = 4 * np.count_nonzero(tops >= edge) > COLUMNS  # of those that just reach it the first are enough
        at = self.above(scores, tops, edge if many else edge - 1)
        if many and len(at) < k:
            at = np.concatenate([at, _first(scores, edge, k - len(at))])
        some = scores[at].astype(np.float64)
        order = np.lexsort((at, -some))[:k]
        return at[order], some[order]

    def real_best(self, keys: list[str], weights: list[float], floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """As whole_best. Scores in 32 bits tell which may be among the k best; those are scored in 64 bits."""
        known = self.known(keys, weights)
        if sum(w * x[4] for w, x in known) <= floor - 1e-9:
            return _NONE
        scores = self.score(known)
        tops = self.tops(scores)
        top = float(tops.max())
        slack = 2.4e-7 * (len(known) + 3) * max(1.0, top) + 1e-9  # errors of 32 bits, and the rounding to nine places
        if top <= floor - slack or top <= 0:
            return _NONE
        at = self.above(scores, tops, max(floor - slack, _kth(tops, k) - 2 * slack, 0.0))
        exact = np.rint(self.exact(known, at) * 1e9) / 1e9
        kept = exact > floor
        at, exact = at[kept], exact[kept]
        best = np.argsort(-exact, kind="stable")[:k]
        return at[best], exact[best]

    def exact(self, known: list[tuple], at: np.ndarray) -> np.ndarray:
        """Scores at some places in 64 bits, in one order of every sum."""
        total = np.zeros(len(at))
        for i in range(0, len(at), 4_096):
            part = at[i : i + 4_096]
            there = np.array([np.searchsorted(x[1], part) for _, x in known])
            lengths, starts = np.array([[len(x[1])] for _, x in known]), np.array([[x[5]] for _, x in known])
            there = np.minimum(there, lengths - 1) + starts
            total[i : i + 4_096] = np.where(self.places[there] == part, self.weights[there] * np.array([[w] for w, _ in known]), 0.0).sum(axis=0)
        return total


def _kth(tops: np.ndarray, k: int) -> float:
    """A score that at least k records reach; 0 if none is known."""
    return np.partition(tops, len(tops) - k)[len(tops) - k].item() if k <= len(tops) else 0


def _first(scores: np.ndarray, wanted: int, n: int) -> np.ndarray:
    """The first n places of a score."""
    found, size = np.zeros(0, np.int64), 4_096
    while True:  # a longer beginning, until it has enough
        found = np.flatnonzero(scores[:size] == wanted)
        if len(found) >= n or size >= len(scores):
            return found[:n]
        size *= 4


_NONE = np.zeros(0, np.int64), np.zeros(0)


class _Best:
    """The best of each record of a chunk so far, in tables of k columns: small arrays of each record would scatter the memory."""

    def __init__(self, k: int, by_source: bool, whole: bool):
        self.k, self.by_source, self.whole = k, by_source, whole
        self.asked: list[tuple[str, list[str], list[float]]] = []
        self.best: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # of a source: how many, places, scores
        self.names: list[pa.Array] = []
        self.sources: list[pa.Array] = []
        self.n = 0

    def meet(self, block: _Block, source: str) -> None:
        k, n = self.k, len(self.asked)
        sizes, places, best = self.best.setdefault(source if self.by_source else "", (np.zeros(n, np.int64), np.zeros((n, k), np.int32), np.zeros((n, k))))
        search = block.whole_best if self.whole else block.real_best
        for j, (_, keys, weights) in enumerate(self.asked):
            m = sizes[j]
            at, scores = search(keys, weights, best[j, -1].item() if m == k else 0.0, k)
            if len(at):
                at, scores = np.concatenate([places[j, :m], at + self.n]), np.concatenate([best[j, :m], scores])
                order = np.argsort(-scores, kind="stable")[:k]
                sizes[j] = m = len(order)
                places[j, :m], best[j, :m] = at[order], scores[order]
        self.names.append(pa.array(block.names, pa.string()))
        self.sources.append(pa.array(block.sources, pa.string()))
        self.n += block.n

    def end(self) -> None:
        """No block follows."""
        self.ids = pa.array([a[0] for a in self.asked], pa.string())
        self.asked = []
        self.names, self.sources = (pa.chunked_array(x, pa.string()).combine_chunks() for x in (self.names, self.sources))

    def told(self, which: np.ndarray) -> Iterator[tuple[pa.Array, pa.Array, pa.Array, np.ndarray]]:
        """Ids, candidates, their sources and scores of some records, in turn for each source."""
        for sizes, places, best in self.best.values():
            if sizes[which].any():
                there = np.arange(self.k) < sizes[which, None]
                at = pa.array(places[which][there])
                yield self.ids.take(pa.array(np.repeat(which, sizes[which]))), self.names.take(at), self.sources.take(at), best[which][there]


def _asked(rows: pa.RecordBatch) -> list[tuple[str, list[str], list[float]]]:
    """Id, keys and weights of records of S1, keys in one order, for every sum."""
    entries = [sorted((e["key"], e["weight"]) for e in x) for x in rows.column("keys").to_pylist()]
    return [(entity, [e[0] for e in x], [e[1] for e in x]) for entity, x in zip(rows.column("entity_id").to_pylist(), entries)]


def _meet(batches: Iterator[pa.RecordBatch], k: int, by_source: bool, whole: bool) -> Iterator[pa.RecordBatch]:
    """The pairs of a chunk: its records come first, blocks after."""
    all_best = _Best(k, by_source, whole)
    for batch in batches:
        n = int((np.asarray(batch.column("turn")) == 0).sum())
        all_best.asked += _asked(batch.slice(0, n))
        for i in range(n, batch.num_rows):
            block = _Block(batch.column("data")[i].as_py(), whole)
            all_best.meet(block, batch.column("source")[i].as_py())
            del block  # before the next is read
    all_best.end()
    for i in range(0, len(all_best.ids), 1_000):
        for *ids, scores in all_best.told(np.arange(i, min(i + 1_000, len(all_best.ids)))):
            yield _batch(*ids, scores, whole)


def _unite(batches: Iterator[pa.RecordBatch], told: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The pairs of a chunk by several searches, one after another, each pair once."""
    searches = [_Best(*x[:3]) for x in told]
    for batch in batches:
        turns = np.asarray(batch.column("turn"))
        for turn in np.unique(turns).tolist():
            one = searches[turn // 2]
            begin, end = np.searchsorted(turns, [turn, turn + 1]).tolist()
            if turn % 2 == 0:
                one.asked += _asked(batch.slice(begin, end - begin))
                continue
            for i in range(begin, end):
                one.meet(_Block(batch.column("data")[i].as_py(), one.whole), batch.column("source")[i].as_py())
    whose: dict[str, list[tuple[int, int]]] = {}
    for s, one in enumerate(searches):
        one.end()
        for j, entity in enumerate(one.ids.to_pylist()):
            whose.setdefault(entity, []).append((s, j))
    entities = list(whose.values())
    for i in range(0, len(entities), 250):
        some, parts = [x for entity in entities[i : i + 250] for x in entity], []
        for s, (one, (_, _, _, factor, plus)) in enumerate(zip(searches, told)):
            for *ids, scores in one.told(np.array([j for t, j in some if t == s], np.int64)):
                parts.append(_batch(*ids, np.floor(scores * factor) + plus, True))
        if parts:
            names = parts[0].schema.names
            most = pa.Table.from_batches(parts).group_by(names[:3], use_threads=False).aggregate([("score", "max")])
            yield from most.rename_columns([c.removesuffix("_max") for c in most.schema.names]).select(names).combine_chunks().to_batches()


def _meet_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of a chunk with a shared key, see _all_pairs()."""
    asked: list[tuple[str, list[str], list[float]]] = []
    for batch in batches:
        n = int((np.asarray(batch.column("turn")) == 0).sum())
        asked += _asked(batch.slice(0, n))
        for i in range(n, batch.num_rows):
            yield from _all_pairs(_Block(batch.column("data")[i].as_py(), True), asked)


def _all_pairs(block: _Block, asked: list[tuple[str, list[str], list[float]]]) -> Iterator[pa.RecordBatch]:
    """Rows of the ids of S1 that have pairs, the ids and sources of the block (one source if all have the same) and the pairs. A pair
    is a number: from the top its place among the ids of S1, its place in the block and its score.
    """
    names, sources = _row(pa.array(block.names, pa.string())), _row(pa.array(block.sources if len(set(block.sources)) > 1 else block.sources[:1], pa.string()))
    own, waiting, n = [], [], 0

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_row(pa.array(own, pa.string())), names, sources, _row(pa.array(np.concatenate(waiting)))], names=["own", "names", "sources", "packed"])

    for entity, keys, weights in asked:
        scores = block.score(block.known(keys, weights))
        at = np.flatnonzero(scores != 0)
        if not len(at):
            continue
        found = scores[at]
        if found.dtype != np.uint8 and found.max() >> SCORE_BITS:
            raise OverflowError(f"a score of {entity} has more than {SCORE_BITS} bits")
        at += len(own) << PLACE_BITS
        at <<= SCORE_BITS
        at |= found
        own.append(entity)
        waiting.append(at)
        n += len(at)
        if n >= PAIRS:
            yield told()
            own, waiting, n = [], [], 0
    if waiting:
        yield told()


def _row(values: pa.Array) -> pa.ListArray:
    """One list of all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _batch(own: pa.Array, other: pa.Array, sources: pa.Array, scores: np.ndarray, whole: bool) -> pa.RecordBatch:
    told = pa.array(scores.astype(np.int32 if whole else np.float64))
    return pa.RecordBatch.from_arrays([own, other, sources, told], names=["source1_entity_id", "candidate_entity_id", "candidate_source", "score"])
