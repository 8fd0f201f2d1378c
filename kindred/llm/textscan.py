"""Words of many texts at once: vectorised numpy over the UTF-8 bytes of Arrow string columns.

A word is a longest run of bytes outside 0x20 and 0x09-0x0D; as all of those are ASCII, cutting bytes cuts the
same words as cutting code points. Hashes are 64 bits wide and depend on a word's bytes alone, never on the batch,
the position or the process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD1B54A32D192ED03)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def slices(batch: pa.RecordBatch | pa.Table, column: str, max_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Row ranges of batch whose texts hold about max_bytes (a longer text comes alone)."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each row starts (one entry more than rows); a null row is empty."""
    column = pa.compute.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, (at - at[0]) if len(column) else np.zeros(1, np.int64)


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    inside = ~_GAP[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def _grown(n: int) -> None:
    """Powers of the base and of its inverse, up to n."""
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 1 << 21)
        inverse = pow(_BASE, -1, 2**64)
        _powers, _inverses = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, inverse))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads its input."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, from prefix sums of byte codes times powers (modulo 2**64)."""
    _grown(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[raw] * _powers[: len(raw)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _inverses[starts])


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its runs of width words; of all its words if it has fewer."""
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    n = len(hashes)
    runs = hashes[: max(0, n - width + 1)].copy()
    for k in range(1, width):
        runs = runs * _STEP + hashes[k : k + len(runs)]
    runs = mixed(runs)
    found = []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        if b - a >= width:
            found.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for i in range(a, b):
                whole = whole * _STEP + hashes[i]
            found.append(mixed(whole))
        else:
            found.append(np.zeros(0, np.uint64))
    return found
