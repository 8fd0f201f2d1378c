import math

import numpy as np
import pytest
from helpers import SF
from pyspark.sql import functions as F

from kindred.llm import queries, vafile


def brute(rows, every, k, scale=64):
    usable = {}
    whole = []
    for vec_id, v in rows:
        if vec_id is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole.append((vec_id, [math.floor(float(np.float32(x)) * scale) for x in v]))
    for vec_id, v in whole:
        if vec_id % every == 0:
            usable.setdefault(vec_id, v)
    out = []
    for query_id, q in usable.items():
        scores = sorted((-sum(a * b for a, b in zip(q, v)), vec_id) for vec_id, v in whole if vec_id != query_id and len(v) == len(q))
        out += [(query_id, i + 1, vec_id, -s) for i, (s, vec_id) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("bits", [1, 4, 8])
def test_against_brute_force(spark, bits):
    rng = np.random.default_rng(bits)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(300)]
    rows += [(300 + i, rows[3][1]) for i in range(40)]  # ties
    rows += [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] * 8), (403, [float("inf")] + [0.0] * 7), (404, []), (410, []), (None, [0.1] * 8)]
    rows += [(500, [0.5, 0.25, 1.0]), (510, [1.0, 1.0, -1.0]), (7, rows[7][1]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("size", F.lit("x")).withColumn("score", F.lit("x"))
    got = sorted(tuple(r) for r in vafile.top_k(df, F.col("vec_id") % 10 == 0, 20, bits=bits).collect())
    assert got == brute(rows, 10, 20)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(vafile, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(vafile, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 6)]) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in vafile.top_k(df, F.col("vec_id") % 10 == 0, 20).collect()) == brute(rows, 10, 20)


def test_large_components(spark, monkeypatch):
    """Finite vectors take part whatever their size; products leave 64 bits at several of these."""
    monkeypatch.setattr(vafile, "VECTOR_BLOCK", 32)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(80)]
    for i, large in enumerate([3e6, 33_554_432.0, -33_554_432.0, 1e9, 4e9, -4e9, 1e18, 1e19, -1e30, 3e38, -3e38, 2e38]):
        v = [float(x) for x in rng.normal(0, 0.3, 8)]
        v[i % 3] = large
        rows.append((100 + 5 * i, v))
    rows += [(200, rows[-1][1]), (201, [4e9, 1.0, -2.0]), (210, [1.0, 4e9, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in vafile.top_k(df, F.col("vec_id") % 10 == 0, 15).collect())
    assert got == [(q, rank, v, min(max(score, -(2**63)), 2**63 - 1)) for q, rank, v, score in brute(rows, 10, 15)]
    keys = [vafile.rank_key(x) for x in (-(2**2000), -(2**64) - 1, -(2**64), -(2**63), 2**63 - 1, 2**63, 2**80, 2**2000)]
    assert keys[3] == keys[4] and keys == sorted(keys) and len(set(keys)) == 7


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vafile.top_k(df, F.col("vec_id") % 10 == 0, 20).count() == 0


def whole(path, spark):
    rows = [r["embedding"] for r in spark.read.parquet(path).orderBy("vec_id").select("embedding").collect()]
    return np.array([[math.floor(64 * float(np.float32(x))) for x in v] for v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)], np.int64)


def test_bounds_save_reads(spark):
    """Cells wider than one value, bounds that hold, and few exact vectors read, on the table of sf0.1."""
    v = whole(f"{SF.replace('sf0.001', 'sf0.1')}/embeddings.parquet", spark)
    cells, codes = vafile.Cells.fit(v, vafile.BITS)
    ends = [x[np.arange(64), codes] for x in (cells.low, cells.high)]
    assert (ends[0] <= v).all() and (v <= ends[1]).all() and codes.max() < 1 << vafile.BITS
    assert (cells.high - cells.low + 1).mean() > 2 and len(np.unique(v)) > 1 << vafile.BITS
    ids, asked = np.arange(len(v)), np.arange(0, len(v), 20)
    exact = v[asked] @ v.T
    lower, upper = cells.lower(codes, v[asked]), cells.upper(codes, v[asked])
    assert (lower <= exact).all() and (exact <= upper).all()
    reads = []
    floors = vafile.least_of_best(lower, asked[:, None] == ids[None, :], 20).min(1).astype(np.int64)
    found = {q: (a, b) for q, a, b in vafile.search_block(asked, v[asked], floors, ids, codes, v, cells, 20, reads)}
    for j, q in enumerate(asked.tolist()):
        scores = sorted((-int(exact[j, i]), i) for i in ids.tolist() if i != q)[:20]
        assert [(-b, a) for a, b in zip(*(x.tolist() for x in found[q]))] == scores
    assert np.mean(reads) < 0.25 * len(v)


def test_floor_ends_reading():
    """A bound of the kth score over other blocks spares this one its reads."""
    rng = np.random.default_rng(0)
    v = np.floor(64 * rng.normal(0, 0.125, (3000, 64))).astype(np.int64)
    cells, codes = vafile.Cells.fit(v, vafile.BITS)
    reads = []
    for floor in (np.iinfo(np.int64).min, int((v[:1] @ v.T).max()) + 5000):
        assert len(list(vafile.search_block(np.array([-1]), v[:1], np.array([floor]), np.arange(3000), codes, v, cells, 20, reads))) == 1
    assert 0 == reads[1] < reads[0]


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(tuple(r) for r in queries.QUERIES["op1_vafile"](spark, SF).collect()) == brute(rows, 20, 20)
