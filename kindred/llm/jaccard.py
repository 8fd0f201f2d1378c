"""N-gram Jaccard self-join by adaptive multi-match prefixes, exact, without broadcasts.

A document's set holds the hashes (64 bits) of its distinct five-word shingles; equal sets become one node. Sets are
ordered rarest shingle first: by a class of how many nodes hold the shingle, then by hash. A linked pair (Jaccard of
at least ``percent`` / 100) has t = ceil(percent |x| / 100) shingles of x in common at least, so for every L up to
t it shares L shingles within the first |x| - t + L of each side.

1. ``frequencies``: each chunk of nodes sends its shingles once, as blobs by hash range. A range counts them and
   answers each chunk with those that two nodes or more hold, and their class. No row is made for a shingle.
2. ``candidates``: a shingle that one node holds matches nothing, so a set with fewer than t others is linked with
   nothing and goes. Each set left chooses its own L: beyond the basic prefix (L = 1) it grows while fewer pairs to
   verify are worth the longer lookup, both estimated from the classes of its prefix.
3. ``families``: nodes that share a shingle of their basic prefixes, directly or over others. No link leaves a family.
4. Families are cut into blocks of bounded rows and bytes. Within a block the shared prefix shingles of all pairs are
   counted by matrix products; pairs that share fewer than the smaller of their two L are refuted, and so are
   those whose sizes or shared shingles cannot reach the threshold. The rest is verified on whole sets. A block
   returns one edge for each node that it joins to a component, never its pairs.
5. A family of several blocks is dealt again by the components found, and blocks meet each other, but for blocks
   of one component and blocks of sizes that cannot link. This finds every link between components.

Defined cases: a null or blank text has an empty set and is linked with nothing; fewer than five words are one
shingle; rows that repeat, or share a doc_id, are documents of their own with the component's smallest doc_id; a
null doc_id is kept, and counts for a component only where all its ids are null; an empty table gives no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kindred.llm import remembered, textscan
from kindred.llm.components import connected_components
from kindred.storage import materialize, release

#: Nodes that hold a shingle of a class, at least; below the first it is held by one node alone.
CLASSES = np.array([2, 16, 128, 1024])
#: Other nodes met under a shingle of each class, for the choice of a prefix.
MET = np.array([0, 3, 40, 350, 3000])


@dataclass(frozen=True)
class JaccardConfig:
    percent: int = 75
    width: int = 5
    lengthening: int = 8  # L is 1 + |x| / lengthening at most
    verifying: int = 16  # verifying a pair costs as much as so many lookups
    block_rows: int = 512
    block_bytes: int = 4_000_000
    chunk_bytes: int = 6_000_000
    range_tokens: int = 4_000_000


def least_shared(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of n shares with any that it links with."""
    return -(-percent * n // 100)


def _sets(part: pa.RecordBatch, width: int) -> list[np.ndarray]:
    raw, at = textscan.text_bytes(part.column("text"))
    raw = textscan.lower_ascii(raw)
    starts, ends, rows = textscan.words(raw, at)
    return textscan.shingles(textscan.span_hashes(raw, starts, ends), rows, part.num_rows, width)


def _set_hash(found: np.ndarray) -> int:
    """Of the whole set: a sum of mixed members and the size, mixed again. 0 is the empty set's alone."""
    with np.errstate(over="ignore"):
        whole = textscan.mixed(np.array([textscan.mixed(found).sum(dtype=np.uint64) + np.uint64(len(found))], np.uint64))[0]
    return int(whole | np.uint64(1)) if len(found) else 0


def _nodes(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([_set_hash(s) for s in sets], np.uint64).view(np.int64))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def signatures(docs: DataFrame, config: JaccardConfig) -> DataFrame:
    """doc_id, n_shingles and node (hash of the set) of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered.forget()
        for batch in batches:
            for part in textscan.slices(batch, "text"):
                sets = _sets(part, config.width)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), _nodes(sets)], names=["doc_id", "n_shingles", "node"])

    return _texts(docs).mapInArrow(scan, "doc_id long, n_shingles long, node long")


def node_texts(docs: DataFrame, config: JaccardConfig) -> DataFrame:
    """chunk, node, text: one text of each node, in chunks of about chunk_bytes (a longer text is one by itself).

    Copies are merged within each task before anything is shuffled, however many there are.
    """

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textscan.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([_nodes(_sets(part, config.width)), part.column("text")], names=["node", "text"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in textscan.slices(batch, "text", config.chunk_bytes):
                if held > config.chunk_bytes // 2:
                    chunk, held = chunk + 1, 0
                held += part.column("text").nbytes
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * part.num_rows, pa.int64()), *part.columns], names=["chunk", "node", "text"])

    found = _texts(docs).select("text").filter("text IS NOT NULL").mapInArrow(named, "node long, text string").filter("node <> 0")
    return found.groupBy("node").agg(F.first("text").alias("text")).mapInArrow(dealt, "chunk long, node long, text string")


def _range_bits(n_tokens: int, config: JaccardConfig) -> int:
    return max(4, math.ceil(math.log2(max(1, n_tokens) / config.range_tokens)))


def frequencies(texts: DataFrame, n_tokens: int, config: JaccardConfig) -> DataFrame:
    """chunk, part, tokens, classes: for each chunk and range of hashes the shingles that two nodes or more hold.

    A shingle is told by the bits of its range and the next 32: the more shingles, the more ranges. Two that look alike
    count together, which may put them into a higher class, in all nodes alike.
    """
    bits = _range_bits(n_tokens, config)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = None, []

        def sent() -> pa.RecordBatch:
            found = np.sort(np.concatenate(held))
            part = (found >> np.uint64(64 - bits)).astype(np.int64)
            told = (found >> np.uint64(32 - bits)).astype(np.uint32)
            at = np.flatnonzero(np.diff(part, prepend=-1))
            blobs = [x.tobytes() for x in np.split(told, at[1:])]
            return pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array([chunk] * len(at), pa.int64()), pa.array(blobs, pa.binary())], names=["part", "chunk", "tokens"])

        for batch in batches:
            for some in textscan.slices(batch, "text"):
                for name, members in zip(some.column("chunk").to_pylist(), _sets(some, config.width)):
                    if name != chunk:
                        if held:
                            yield sent()
                        chunk, held = name, []
                    held.append(members)
        if held:
            yield sent()

    def answer(told: pa.Table) -> pa.Table:
        blobs = told.column("tokens").to_pylist()
        tokens = np.frombuffer(b"".join(blobs), np.uint32)
        order = np.argsort(tokens, kind="stable")
        new = np.diff(tokens[order], prepend=tokens[order[0]]) != 0
        group = np.cumsum(new)
        kind = np.empty(len(tokens), np.uint8)
        kind[order] = np.searchsorted(CLASSES, np.bincount(group), side="right")[group]
        ends = np.cumsum([len(b) // 4 for b in blobs])
        back, kinds = [], []
        for a, b in zip([0, *ends.tolist()], ends.tolist()):
            some = kind[a:b] > 0
            found, where = np.unique(tokens[a:b][some], return_index=True)
            back.append(found.tobytes())
            kinds.append(kind[a:b][some][where].tobytes())
        return pa.Table.from_arrays([told.column("chunk"), told.column("part"), pa.array(back, pa.binary()), pa.array(kinds, pa.binary())], names=["chunk", "part", "tokens", "classes"])

    told = texts.select("chunk", "text").mapInArrow(send, "part long, chunk long, tokens binary")
    return told.groupBy("part").applyInArrow(answer, "chunk long, part long, tokens binary, classes binary")


def chosen_level(kinds: np.ndarray, n: int, unshared: int, config: JaccardConfig) -> int:
    """L of a set of n shingles: the multiple of prefix matches with the least estimated cost.

    kinds: classes of its shared shingles, rarest first. Looking up costs 1 for every other node met; of those met,
    one in L at most is a candidate to verify.
    """
    t = int(least_shared(n, config.percent))
    met = np.concatenate([[0], np.cumsum(MET[kinds])])
    levels = [1]
    while 2 * levels[-1] <= min(t, 1 + n // config.lengthening):
        levels.append(2 * levels[-1])
    costs = [met[min(len(kinds), max(0, n - t + level - unshared))] * (1 + config.verifying / level) for level in levels]
    return levels[int(np.argmin(costs))]


def candidates(texts: DataFrame, told: DataFrame, n_tokens: int, config: JaccardConfig) -> DataFrame:
    """node, n, level (L), basic and longer (shared shingles within the prefixes), members (all shared shingles, rarest first).

    Sets that are linked with nothing are left out where their unshared shingles prove it.
    """
    bits = _range_bits(n_tokens, config)
    out = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("level", pa.int64()), ("basic", pa.int64()), ("longer", pa.int64()), ("members", pa.binary())])

    def choose(texts: pa.Table, told: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if told.num_rows:
            told = told.sort_by("part")
            tokens = [np.frombuffer(b, np.uint32).astype(np.uint64) | (np.uint64(part) << np.uint64(32)) for part, b in zip(told.column("part").to_pylist(), told.column("tokens").to_pylist())]
            known = np.concatenate([*tokens, np.zeros(0, np.uint64)])
            kinds_of = np.frombuffer(b"".join(told.column("classes").to_pylist()), np.uint8)
            for batch in texts.to_batches() if len(known) else []:
                for part in textscan.slices(batch, "text"):
                    for node, members in zip(part.column("node").to_pylist(), _sets(part, config.width)):
                        look = members >> np.uint64(32 - bits)
                        where = np.minimum(np.searchsorted(known, look), len(known) - 1)
                        shared = known[where] == look
                        n, s = len(members), int(shared.sum())
                        t = int(least_shared(n, config.percent))
                        if s < t:
                            continue
                        members, kinds = members[shared], kinds_of[where[shared]]
                        order = np.lexsort((members, kinds))
                        level = chosen_level(kinds[order], n, n - s, config)
                        rows.append((node, n, level, s - t + 1, min(s, s - t + level), members[order].tobytes()))
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), out)], schema=out) if rows else out.empty_table()

    kinds = "node long, n long, level long, basic long, longer long, members binary"
    return texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(choose, kinds)


def families(found: DataFrame) -> DataFrame:
    """node, family of the nodes that share a shingle of their basic prefixes with another, directly or over others."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            basic, blobs = np.asarray(batch.column("basic")), batch.column("members").to_pylist()
            tokens = np.frombuffer(b"".join([b[: 8 * k] for b, k in zip(blobs, basic.tolist())]), np.int64)
            nodes = np.repeat(np.asarray(batch.column("node")), basic)
            for i in range(0, len(tokens), 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(tokens[i : i + 500_000]), pa.array(nodes[i : i + 500_000])], names=["token", "node"])

    rows = found.select("node", "basic", "members").mapInArrow(spread, "token long, node long")
    low = rows.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("token", "low")
    edges = materialize(rows.join(low, "token").filter("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct(), "met")
    labels = connected_components(edges)
    release(edges)
    out = labels.withColumnRenamed("label", "family")
    out._kindred_path = labels._kindred_path
    return out


class Block:
    """Nodes whose pairs are compared in one task: arrays by row, and the shared shingles of each."""

    def __init__(self, rows: pa.Table):
        node = np.asarray(rows.column("node"))
        _, first = np.unique(node, return_index=True)
        rows = rows.take(pa.array(np.sort(first)))
        self.node, self.n, self.level, self.longer, self.group, self.side = (np.asarray(rows.column(c)) for c in ("node", "n", "level", "longer", "group", "side"))
        self.members = [np.frombuffer(b, np.uint64) for b in rows.column("members").to_pylist()]
        self.shared = np.array([len(m) for m in self.members], np.int64)


def common(members: list[np.ndarray], cells: int = 4_000_000) -> np.ndarray:
    """Sizes of the intersections of every two sets, exact, by products of 0/1 matrices over some shingles at a time."""
    n = len(members)
    total = np.zeros((n, n), np.float32)  # counts stay far below 2**24
    sizes = [len(m) for m in members]
    tokens, row = np.concatenate([*members, np.zeros(0, np.uint64)]), np.repeat(np.arange(n), sizes)
    _, place, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    some = counts[place] > 1
    column = (np.cumsum(counts > 1) - 1)[place[some]]
    row = row[some]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    step = max(1, cells // max(1, n))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [start, start + step])
        matrix = np.zeros((n, int(column[b - 1]) - start + 1), np.float32)
        matrix[row[a:b], column[a:b] - start] = 1
        total += matrix @ matrix.T
    return total.astype(np.int64)


def links(block: Block, config: JaccardConfig) -> np.ndarray:
    """Symmetric boolean matrix of the verified links between nodes of different groups (and sides, if there are two)."""
    percent = config.percent
    n, sides = block.n, block.side
    apart = block.group[:, None] != block.group[None, :]
    if sides.any() and not sides.all():
        apart &= sides[:, None] != sides[None, :]
    low, high = np.minimum(n[:, None], n[None, :]), np.maximum(n[:, None], n[None, :])
    apart &= 100 * low >= percent * high
    apart &= (100 + percent) * np.minimum(block.shared[:, None], block.shared[None, :]) >= percent * (low + high)
    if not apart.any():
        return apart
    there = np.flatnonzero(apart.any(1))
    met = common([block.members[i][: block.longer[i]] for i in there.tolist()])
    able = apart[np.ix_(there, there)] & (met >= np.minimum(block.level[there][:, None], block.level[there][None, :]))
    left = np.flatnonzero(able.any(1))
    found = np.zeros_like(apart)
    if len(left):
        able, there = able[np.ix_(left, left)], there[left]
        both = common([block.members[i] for i in there.tolist()])
        found[np.ix_(there, there)] = able & (100 * both >= percent * (n[there][:, None] + n[there][None, :] - both))
    return found


def spanning(block: Block, linked: np.ndarray) -> list[tuple[int, int]]:
    """An edge (smallest node of its component, node) for every other node of each component."""
    seen, edges = np.zeros(len(linked), bool), []
    for i in np.argsort(block.node, kind="stable").tolist():
        if seen[i] or not linked[i].any():
            continue
        reached, front = np.zeros(len(linked), bool), np.array([i])
        reached[i] = True
        while len(front):
            near = linked[front].any(0) & ~reached
            reached |= near
            front = np.flatnonzero(near)
        seen |= reached
        edges += [(int(block.node[i]), int(x)) for x in block.node[reached] if x != block.node[i]]
    return edges


def compared(rows: DataFrame, config: JaccardConfig) -> DataFrame:
    """a, b: edges found within each block. rows: block, side, group, node, n, level, longer, members."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        edges: list[tuple[int, int]] = []

        def close() -> None:
            block = Block(pa.Table.from_batches(held))
            if len(block.node) > 1:
                edges.extend(spanning(block, links(block, config)))
            held.clear()

        for batch in batches:
            names = np.asarray(batch.column("block"))
            cuts = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), len(names)]
            for a, b in zip(cuts, cuts[1:]):
                if held and b > a and held[-1].column("block")[0].as_py() != names[a]:
                    close()
                if b > a:
                    held.append(batch.slice(a, b - a))
            if len(edges) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*edges)], names=["a", "b"])
                edges.clear()
        if held:
            close()
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*edges)], names=["a", "b"])

    rows = rows.select("block", "side", "group", "node", "n", "level", "longer", "members").repartition("block").sortWithinPartitions("block")
    return rows.mapInArrow(compare, "a long, b long")


def _blocks_of(nodes: str, size: str, config: JaccardConfig):
    """How many blocks so many nodes and bytes make."""
    return F.greatest(F.ceil(F.col(nodes) / config.block_rows), F.ceil(F.col(size) / config.block_bytes), F.lit(1)).cast("long")


def _across(found: DataFrame, of: DataFrame, edges: DataFrame, config: JaccardConfig) -> DataFrame:
    """Edges between the components that the first blocks of large families have left. of: node, family, bytes."""
    labels = connected_components(edges)
    grouped = of.join(labels, "node", "left").withColumn("group", F.coalesce("label", "node")).drop("label")
    # linked sizes lie in the same band or in neighbouring ones
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / config.percent) + 1e-9).cast("long")
    grouped = materialize(grouped.join(found.select("node", "n"), "node").withColumn("band", band), "grouped")
    release(labels)
    whole = grouped.groupBy("family", "group").agg(F.count("*").alias("k"), F.sum("bytes").alias("size")).withColumn("parts", _blocks_of("k", "size", config))
    # a component that fills a block or more has blocks of its own: they need not meet each other
    own = F.when(F.col("parts") > 1, F.col("group"))
    placed = grouped.join(whole.select("family", "group", "parts"), ["family", "group"]).withColumn("own", own).drop("parts")
    kinds = ["family", "band", "own"]
    sizes = placed.groupBy(kinds).agg(F.count("*").alias("k"), F.sum("bytes").alias("size")).select(*kinds, _blocks_of("k", "size", config).alias("parts"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in kinds]
    placed = placed.alias("p").join(sizes.alias("s"), same[0] & same[1] & same[2]).select("p.*", F.pmod(F.xxhash64("node"), F.col("parts")).alias("slot"))
    placed = placed.withColumn("at", F.xxhash64("family", "band", F.coalesce(F.col("own").cast("string"), F.lit("-")), "slot"))
    placed = materialize(placed.select("node", "family", "group", "band", "own", "at"), "placed")
    blocks = placed.groupBy("family", "band", "own", "at").agg(F.min("group").alias("g1"), F.max("group").alias("g2"))
    x, y = (blocks.select("family", *[F.col(c).alias(f"{c}_{s}") for c in ("band", "at", "g1", "g2")]) for s in "xy")
    one = (F.col("g1_x") == F.col("g2_x")) & (F.col("g1_y") == F.col("g2_y")) & (F.col("g1_x") == F.col("g1_y"))
    meet = x.join(y, "family").filter((F.col("at_x") <= F.col("at_y")) & (F.abs(F.col("band_x") - F.col("band_y")) <= 1) & ~one)
    meet = meet.select("at_x", "at_y", F.xxhash64("family", "at_x", "at_y").alias("block"))
    ends = meet.select(F.col("at_x").alias("at"), "block", F.lit(0).alias("side")).union(meet.filter("at_x <> at_y").select(F.col("at_y").alias("at"), "block", F.lit(1).alias("side")))
    rows = placed.select("node", "group", "at").join(ends, "at").join(found, "node")
    more = materialize(compared(rows, config), "across")
    release(grouped, placed)
    return more


def linked_nodes(found: DataFrame, config: JaccardConfig) -> DataFrame:
    """a, b: edges that join the nodes of each component."""
    family = families(found)
    of = materialize(family.join(found.select("node", F.octet_length("members").alias("bytes")), "node"), "families")
    release(family)
    sizes = of.groupBy("family").agg(F.count("*").alias("k"), F.sum("bytes").alias("size")).select("family", _blocks_of("k", "size", config).alias("parts"))
    dealt = of.join(sizes, "family").withColumn("block", F.xxhash64("family", F.pmod(F.xxhash64("node"), F.col("parts"))))
    rows = dealt.select("node", "block").join(found, "node").select("*", F.lit(0).alias("side"), F.col("node").alias("group"))
    edges = materialize(compared(rows, config), "within")
    large = materialize(dealt.filter("parts > 1").select("node", "family", "bytes"), "large")
    if not large.isEmpty():
        edges = edges.union(_across(found, large, edges.join(large, edges["a"] == large["node"], "left_semi"), config))
    return edges


def _labelled(signed: DataFrame, docs: DataFrame, config: JaccardConfig) -> tuple[DataFrame, DataFrame]:
    """nodes (node, n, first_id: the smallest doc_id) and labels (node, label) of those that are linked with others.

    signed: doc_id, n_shingles and node of every row of docs.
    """
    nodes = materialize(signed.filter("n_shingles > 0").groupBy("node").agg(F.min("n_shingles").alias("n"), F.min("doc_id").alias("first_id")), "nodes")
    n_tokens = nodes.agg(F.sum("n")).first()[0] or 0
    texts = materialize(node_texts(docs, config), "texts")
    told = materialize(frequencies(texts, n_tokens, config), "frequencies")
    found = materialize(candidates(texts, told, n_tokens, config), "candidates")
    release(texts, told)
    edges = materialize(linked_nodes(found, config), "links")
    release(found)
    labels = connected_components(edges)
    release(edges)
    return nodes, labels


def jaccard_components(docs: DataFrame, config: JaccardConfig = JaccardConfig()) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    signed = materialize(signatures(docs, config), "signatures")
    nodes, labels = _labelled(signed, docs, config)
    named = nodes.join(labels, "node").select("node", "first_id", "label")
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = materialize(named.join(smallest, "label").select("node", "component_id").union(nodes.join(labels, "node", "left_anti").select("node", "first_id")), "named")
    release(nodes, labels)
    return signed.select("doc_id", "n_shingles", "node").join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def first_of_each(docs: DataFrame, config: JaccardConfig = JaccardConfig()) -> DataFrame:
    """One row of each component, and every row with an empty set.

    It is the row with the smallest doc_id (missing ones last); among equal ids the smallest hash of a text decides, then
    that of its set, then the other columns, written as JSON. Rows are merged by set within tasks before a shuffle.
    """
    signed = materialize(signatures(docs, config), "signatures")
    nodes, labels = _labelled(signed, docs, config)
    release(signed)
    best = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "node"))
    named = nodes.join(labels, "node")
    others = named.join(named.groupBy("label").agg(best.alias("best")), "label").filter(F.col("node") != F.col("best.node")).select("node")
    others = materialize(others, "others")
    release(nodes, labels)

    node = "set_hash"
    while node.lower() in {c.lower() for c in docs.columns}:
        node += "_"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered.forget()
        for batch in batches:
            for part in textscan.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, _nodes(_sets(part, config.width))], names=[*part.schema.names, node])

    rows = docs.mapInArrow(hashed, StructType([*docs.schema.fields, StructField(node, LongType())]))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    id_ = F.col("doc_id").cast("long")
    order = F.struct(id_.isNull(), id_, F.xxhash64(F.col("text").cast("string")), F.to_json(F.struct(*rest)) if rest else F.lit(""))
    # rows without a set are groups of their own
    alone = F.when(F.col(node) == 0, F.monotonically_increasing_id()).otherwise(F.lit(-1))
    kept = rows.select(F.col(node).alias("node"), alone.alias("alone"), F.struct(*docs.columns).alias("row"), order.alias("order"))
    kept = kept.groupBy("node", "alone").agg(F.min_by("row", "order").alias("row"))
    return kept.join(others, "node", "left_anti").select("row.*")
