"""Fixed-width bit packing of token ids, with block offsets for random access.

A container holds whole documents: a header, the documents' ids and lengths, the byte offset of every block and the
blocks. Each token id takes ``width`` bits, the fewest that the vocabulary needs, most significant bit first; a
block holds ``BLOCK`` ids and starts on a byte. Reading a range touches only the blocks that it meets.

Layout (little-endian): b"KPK1", width u32, block u32, documents u64, ids u64 | has_id u8 per document, doc_id i64
per document, length u64 per document | offset u64 per block and the end | blocks.

Containers are rows of a Parquet dataset (shard, segment, ids before the segment in the shard, payload), so that
any store that Spark reaches holds them, and Spark's commit protocol keeps one copy of each task's output.

Defined cases: a null text is an empty document (only the end id); a null doc_id sorts first and comes back null;
repeated rows are documents of their own, in the order of their texts; an empty table gives an empty dataset.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.llm import textscan, tokens
from kindred.storage import new_path

MAGIC = b"KPK1"
BLOCK = 4096
SEGMENT_IDS = 1 << 20
_HEAD = struct.Struct("<4sIIQQ")


def bits_needed(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """ids as consecutive fields of width bits, filled up with zeros to a byte."""
    ids = np.asarray(ids, np.uint32)
    if width in (8, 16, 32):
        return ids.astype(f">u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype(">u4").view(np.uint8)).reshape(-1, 32)[:, 32 - width :]
    return np.packbits(bits.reshape(-1)).tobytes()


def unpack(data: bytes | memoryview, count: int, width: int) -> np.ndarray:
    """The first count fields of width bits."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f">u{width // 8}", count).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width).reshape(count, width)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, 32 - width :] = bits
    return np.packbits(wide.reshape(-1)).view(">u4").astype(np.uint32)


def container(doc_ids: list[int | None], encoded: list[bytes], width: int) -> bytes:
    """encoded: each document's ids as little-endian 32-bit integers."""
    lengths = np.array([len(x) // 4 for x in encoded], "<u8")
    ids = np.frombuffer(b"".join(encoded), "<u4")
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id does not fit {width} bits")
    blocks = [pack(ids[i : i + BLOCK], width) for i in range(0, len(ids), BLOCK)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    return b"".join([
        _HEAD.pack(MAGIC, width, BLOCK, len(encoded), len(ids)),
        np.array([x is not None for x in doc_ids], np.uint8).tobytes(),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        lengths.tobytes(), offsets.tobytes(), *blocks,
    ])


class Reader:
    """Random access to a container."""

    def __init__(self, data: bytes):
        magic, self.width, self.block, n_docs, self.n_ids = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a container of packed ids")
        at = _HEAD.size
        known = np.frombuffer(data, np.uint8, n_docs, at)
        ids = np.frombuffer(data, "<i8", n_docs, at + n_docs)
        self.doc_ids = [int(x) if k else None for x, k in zip(ids, known)]
        self.lengths = np.frombuffer(data, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        at += 17 * n_docs
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at).astype(np.int64)
        self._body = memoryview(data)[at + 8 * (n_blocks + 1) :]

    def ids(self, start: int, count: int) -> np.ndarray:
        """count ids from start on, from the blocks that hold them."""
        if count <= 0:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (start + count - 1) // self.block
        got = [
            unpack(self._body[self.offsets[b] : self.offsets[b + 1]], min(self.block, self.n_ids - b * self.block), self.width)
            for b in range(first, last + 1)
        ]
        return np.concatenate(got)[start - first * self.block :][:count]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.lengths[i]))


def write_packed(docs: DataFrame, path: str, vocabulary: str | None = None, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode docs (doc_id, text) in ascending order of doc_id and write the containers to path."""
    vocabulary = vocabulary or tokens.default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tokens.codec(vocabulary)
        width, end = bits_needed(codec.vocabulary_size), np.array([tokens.END_ID], "<u4").tobytes()
        shard, segment, before = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        held: list[bytes] = []
        n = 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"shard": [shard], "segment": [segment], "before": [before], "n_ids": [n], "payload": [container(names, held, width)]},
                pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())]),
            )

        for batch in batches:
            for part in textscan.slices(batch, "text", 1_000_000):
                for name, ids in zip(part.column("doc_id").to_pylist(), codec.encode([t or "" for t in part.column("text").to_pylist()])):
                    names.append(name)
                    held.append(ids + end)
                    n += len(ids) // 4 + 1
                    if n >= segment_ids:
                        yield row()
                        segment, before, n, names, held = segment + 1, before + n, 0, [], []
        if held:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # equal ids, equal rows too, go over as many partitions as it takes
    order = ["doc_id", "h", "u"]
    ordered = rows.withColumn("h", F.xxhash64("text")).withColumn("u", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("doc_id", "text").mapInArrow(encode, "shard int, segment int, before long, n_ids long, payload binary").write.parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the containers at path."""
    stored = spark.read.schema("shard int, segment int, before long, n_ids long, payload binary").parquet(path)
    # one row for each shard, that is for each task that wrote
    totals = stored.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    starts = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    rows = stored.join(F.broadcast(starts), "shard").select((F.col("shard_start") + F.col("before")).alias("start"), "payload")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column("start").to_pylist(), batch.column("payload")):
                reader = Reader(payload.as_py())
                ids = memoryview(reader.ids(0, reader.n_ids).astype("<u4").tobytes())
                crc = [zlib.crc32(ids[4 * a : 4 * (a + n)]) for a, n in zip(reader.starts.tolist(), reader.lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reader.doc_ids, pa.int64()), pa.array(start + reader.starts), pa.array(reader.lengths), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return rows.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def packed_ids(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write docs to a fresh dataset in the shared folder and read it back."""
    path = new_path(docs.sparkSession, "packed")
    write_packed(docs, path, vocabulary)
    return read_packed(docs.sparkSession, path)
