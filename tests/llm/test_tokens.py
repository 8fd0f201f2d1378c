import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import SF, awkward, awkward_rows, empty
from tokenizers import Tokenizer

from kindred.llm import bitpack, packing, queries, tokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_vocabulary())


def test_codec_equals_library(library):
    texts = [r[1] or "" for r in awkward_rows()] + ["a\n \nb", "  lead", "trail  ", "x \t y", "é́ z", "it's we'll I'd", "a.b,c!! THE&&& \n\n Q", "\x1cfoo \x1d bar"]
    codec = tokens.codec(tokens.default_vocabulary())
    for _ in range(2):
        for text, got in zip(texts, codec.encode(texts)):
            assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("width", [1, 3, 8, 13, 16, 17, 31, 32])
def test_bits_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 1001, dtype=np.uint64).astype(np.uint32)
    data = bitpack.pack(ids, width)
    assert len(data) == -(-1001 * width // 8)
    assert (bitpack.unpack(data, 1001, width) == ids).all()


def test_container_random_access():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 50257, n).astype("<u4") for n in (0, 1, 5000, 4096, 7, 9000)]
    reader = bitpack.Reader(bitpack.container([5, None, 7, 8, 9, 10], [d.tobytes() for d in docs], 17))
    assert reader.doc_ids == [5, None, 7, 8, 9, 10]
    for i, d in enumerate(docs):
        assert (reader.document(i) == d).all()
    everything = np.concatenate(docs)
    assert (reader.ids(4090, 5010) == everything[4090:9100]).all()


def _expected(library, rows):
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_packed_ids(spark, library):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    got = [tuple(r) for r in bitpack.packed_ids(awkward(spark)).collect()]
    key = lambda r: (r[1], r[2])
    assert sorted(got, key=key) == sorted(_expected(library, rows), key=key)
    assert bitpack.packed_ids(empty(spark)).count() == 0


def test_op9_query(spark, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.QUERIES["op9_bitpack"](spark, SF).collect()]
    assert sorted(got) == sorted(_expected(library, docs))


def _check_packing(rows, docs, library):
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"], r["start"] + r["length"] if r["doc_id"] == 7 else None].append(r)
    expected = Counter()
    for doc_id, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        n = len(ids)
        first = n if n <= 2048 else n % 2048 or 2048
        bounds = [0, first, *range(first + 2048, n + 1, 2048)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            expected[doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences), -(-sum(r["length"] for r in rows) // 2048)


def test_packing(spark, library):
    rows = packing.pack_documents(awkward(spark)).collect()
    _check_packing(rows, [(r[0], r[1]) for r in awkward_rows()], library)
    assert packing.pack_documents(empty(spark)).count() == 0


def test_op10_query(spark, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    made, bound = _check_packing(queries.QUERIES["op10_packing"](spark, SF).collect(), docs, library)
    assert made <= bound * 1.03 + 1


@pytest.mark.parametrize("seed", range(6))
def test_recipes_hold_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(2048, np.exp(rng.normal(5 + seed / 2, 1.0, 3000)).astype(int) + 1)
    histogram = Counter(lengths.tolist())
    back, n = Counter(), 0
    for parts, repeat in packing.recipes(histogram):
        assert sum(parts) <= 2048 and repeat > 0
        n += repeat
        for x in parts:
            back[x] += repeat
    assert back == histogram
    assert packing.recipes({}) == []
    half = [x for x in lengths if x > 1024]
    assert n <= max(-(-int(lengths.sum()) // 2048), len(half)) * 1.1 + 2


def test_nonnegative_least_squares():
    rng = np.random.default_rng(0)
    a, x = rng.random((20, 8)), np.array([0, 3, 0, 1, 0, 0, 2, 5.0])
    assert np.allclose(packing.nonnegative_least_squares(a, a @ x), x, atol=1e-3)
