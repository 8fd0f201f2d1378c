"""Scores of pairs in blocks: against brute force, with ties across blocks, weights beyond a byte, and without a join of pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import blocking as B
from kindred.operators import pairs as P
from kindred.operators import tfidf
from kindred.operators.records import normalized_records

POST = "source string, rid long, key string, weight double"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def crowd(spark):
    """Records that nearly all share words: pairs are nearly all of the product of both sides."""
    draw, words = random.Random(7), ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows = [(i, f"S{i % 3 + 1}", f"S{i % 3 + 1}-{i}", " ".join(draw.choices(words, k=3)), " ".join(draw.choices(words, k=4)) + f" {10000 + i % 9}", "en") for i in range(240)]
    rows += [(900, "S1", "S1-900", None, None, None), (901, "S2", "S2-901", "", "", "")]
    return normalized_records(spark.createDataFrame(rows, "rid long, source string, entity_id string, business_name string, business_address string, country string")).cache()


def test_candidates_move_no_pair(crowd):
    """No plan of candidates joins pairs to anything or ranks them after an exchange."""
    for found in (B.candidates(crowd), tfidf.cosine_top(crowd, 5)):
        plan = plan_of(found)
        assert "Join" not in plan and "Window" not in plan and "HashAggregate" not in plan


@pytest.mark.parametrize("k", [None, 3])
@pytest.mark.parametrize("by_source", [True, False])
@pytest.mark.parametrize("whole", [True, False])
def test_pairs_by_brute_force(spark, monkeypatch, tmp_path, k, by_source, whole):
    """Small blocks, ties in several of them, a key twice in a record, weights beyond a byte, records without a partner."""
    if k is None and not whole:
        pytest.skip("all pairs have whole scores")
    monkeypatch.setattr(P, "CHUNK", 16)
    draw, keys = random.Random(3), [f"k{i}" for i in range(12)]
    post, ids = [], {}
    for rid in range(150):
        source = f"S{rid % 3 + 1}"
        ids[rid] = f"{source}-{rid}"
        for key in draw.choices(keys, [2 ** (i % 6) for i in range(12)], k=4):
            weight = 1.0 if source == "S1" else draw.choice([1.0, 3.0]) if whole else draw.choice([0.25, 0.5, 0.3])
            post.append((source, rid, key, 300.0 if whole and source == "S3" and rid % 5 == 0 else weight))
    post.append(("S1", 150, "alone", 1.0))
    ids[150] = "S1-150"
    df, records = spark.createDataFrame(post, POST), spark.createDataFrame(list(ids.items()), "rid long, entity_id string")
    own, others = (P.listed(df.filter(side), records) for side in ("source = 'S1'", "source <> 'S1'"))
    got = {(r[0], r[1], r[2], r[3]) for r in P.pairs(own, others, k, by_source, whole).collect()}
    expected = {}
    for s, a, key, w in post:
        for t, b, other, v in post:
            if s == "S1" and t != "S1" and key == other:
                expected[ids[a], ids[b], t] = expected.get((ids[a], ids[b], t), 0) + w * v
    groups = {}
    for (a, b, t), score in expected.items():
        groups.setdefault((a, t if by_source else ""), []).append((-round(score, 9), b, t))
    assert got == {(a, b, t, -score) for (a, _), found in groups.items() for score, b, t in sorted(found)[:k]}


def test_blocks_in_order():
    """Of equal scores the smaller id stays, whichever block it is in."""
    import pyarrow as pa

    entry = pa.list_(pa.struct([("key", pa.string()), ("weight", pa.float64())]))
    keys = [[{"key": "x", "weight": 1.0}]]
    ids = sorted(f"S2-{i}" for i in range(20))
    blocks = []
    for part in (ids[:7], ids[7:14], ids[14:]):
        rows = pa.RecordBatch.from_arrays([pa.array(["S2"] * len(part)), pa.array(part), pa.array(keys * len(part), entry)], names=["source", "entity_id", "keys"])
        blocks += P._build(iter([rows]), True)
    kinds = {"turn": pa.int32(), "entity_id": pa.string(), "keys": entry, "source": pa.string(), "data": pa.binary()}
    rows = [(0, "S1-0", keys[0], None, None), *((1, None, None, b.column("source")[0].as_py(), b.column("data")[0].as_py()) for b in blocks)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))
    for whole in (True, False):
        (out,) = P._meet(iter([batch]), 9, True, whole)
        assert out.column("candidate_entity_id").to_pylist() == ids[:9]


def test_records_without_words(crowd):
    found = B.candidates(crowd).filter((F.col("source1_entity_id") == "S1-900") | (F.col("candidate_entity_id") == "S2-901"))
    assert {(r["source1_entity_id"], r["candidate_entity_id"]) for r in found.collect()} <= {("S1-900", "S2-901")}
    assert B.candidates(crowd.limit(0)).isEmpty() and B.candidates(crowd.filter("source = 'S1'")).isEmpty()


def test_features_carry_what_they_need(crowd):
    """Pairs take no list along, and no text that the wanted features don't read."""
    from kindred.operators.features import build_features

    made = build_features(B.candidates(crowd), crowd).select("source1_entity_id", "name_lev_ratio", "name_token_jaccard")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "_3g" not in plan and "_name_norm" in plan and "_addr_strip" not in plan


def block_of(rows):
    """A block of (id, {key: weight}) rows of S2."""
    import pyarrow as pa

    entry = pa.list_(pa.struct([("key", pa.string()), ("weight", pa.float64())]))
    keys = [[{"key": k, "weight": w} for k, w in has.items()] for _, has in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(["S2"] * len(rows)), pa.array([i for i, _ in rows]), pa.array(keys, entry)], names=["source", "entity_id", "keys"])
    (block,) = P._build(iter([batch]), True)
    return block.column("data")[0].as_py()


@pytest.mark.parametrize("whole", [True, False])
def test_few_records_are_ranked(monkeypatch, whole):
    """Of many records with a shared word, those that can't be among the best are neither sorted nor scored again."""
    draw, n, k = random.Random(5), 10_000, 20
    rows = [(f"S2-{i:05d}", {"all": 1.0} | {f"w{j}": 3.0 if whole else 0.3 for j in draw.sample(range(40), 3)}) for i in range(n)]
    block, read = P._Block(block_of(rows), whole), []
    above = P._Block.above
    monkeypatch.setattr(P._Block, "above", lambda *a: read.append(len(found := above(*a))) or found)
    for wanted in (["all"], ["all", "w1", "w2", "w3"], [f"w{j}" for j in range(40)]):
        for floor in (0.0, 1.0, 4.0, 100.0):
            scores = [round(sum(has.get(x, 0.0) for x in wanted), 9) for _, has in rows]
            expected = sorted((-s, i) for i, s in enumerate(scores) if s > floor)[:k]
            at, found = (block.whole_best if whole else block.real_best)(wanted, [1.0] * len(wanted), floor, k)
            assert [(-s, i) for i, s in zip(at.tolist(), found.tolist())] == expected
    read.clear()
    (block.whole_best if whole else block.real_best)(["all", "w1", "w2", "w3"], [1.0] * 4, 0.0, k)
    assert max(read) < n / 4


def test_entity_counts_read_predictions_once(spark):
    from kindred.operators import evaluate as E

    predicted = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "source1_entity_id string, candidate_entity_id string")
    truth = spark.createDataFrame([("a", "x"), ("c", "z")], "source1_entity_id string, matched_entity_id string")
    counts = E.entity_counts(predicted, truth, spark.createDataFrame([("a",), ("d",), ("d",)], "source1_entity_id string"))
    assert sorted(map(tuple, counts.collect())) == [("a", 1, 2, 1), ("b", 0, 1, 0), ("c", 0, 0, 1), ("d", 0, 0, 0)]
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("FullOuter") == 1


@pytest.mark.parametrize("config", [B.HYBRID, B.BlockingConfig(per_source=4, tfidf_top=6, tfidf_ngrams=2, score_scale=10)])
def test_searches_are_united_without_moving_pairs(crowd, config, monkeypatch):
    """Keys and cosines of a record meet in one task: each pair once, with its greater score, and no pair is grouped after an exchange."""
    monkeypatch.setattr(P, "CHUNK", 16)
    found = B.candidates(crowd, config)
    plan = plan_of(found)
    assert "Join" not in plan and "Window" not in plan and "Aggregate" not in plan
    expected = {}
    for a, b, source, score in B.token_candidates(crowd, config).collect():
        expected[a, b, source] = score
    for a, b, source, cosine in tfidf.cosine_top(crowd, config.tfidf_top, config.tfidf_ngrams).collect():
        expected[a, b, source] = max(expected.get((a, b, source), 0), int(cosine * 100.0) + 20)
    got = found.collect()
    assert len(got) == len(expected) and {tuple(r)[:3]: r["block_score"] for r in got} == expected


def test_united_ids_that_repeat(spark):
    """Records of S1 with the same id, and others with the same id, give a pair once, with the greatest score."""
    post = spark.createDataFrame([("S1", 1, "x", 1.0), ("S1", 2, "y", 1.0), ("S2", 3, "x", 2.0), ("S2", 4, "y", 3.0), ("S3", 5, "y", 7.0)], POST)
    ids = spark.createDataFrame([(1, "S1-a"), (2, "S1-a"), (3, "S2-b"), (4, "S2-b"), (5, "S3-c")], "rid long, entity_id string")
    sides = [P.listed(post.filter(side), ids) for side in ("source = 'S1'", "source <> 'S1'")]
    found = P.united([P.search(*sides, 5, factor=10), P.search(*sides, 1, by_source=False, whole=False, factor=4.0, plus=1)])
    assert sorted(map(tuple, found.collect())) == [("S1-a", "S2-b", "S2", 30), ("S1-a", "S3-c", "S3", 70)]


def test_best_are_kept_in_tables():
    """A record's best are rows of a source's table: no small array of each record stays between blocks."""
    best = P._Best(2, True, True)
    best.asked = [("S1-1", ["x"], [1.0]), ("S1-2", ["z"], [1.0])]
    for ids in (("a", "b"), ("c", "d")):
        best.meet(P._Block(block_of([(i, {"x": 2.0 if i == "d" else 1.0}) for i in ids]), True), "S2")
    (tables,) = best.best.values()
    assert [t.shape for t in tables] == [(2,), (2, 2), (2, 2)] and tables[0].tolist() == [2, 0]
    best.end()
    ((whose, names, _, scores),) = best.told(np.arange(2))
    assert (whose.to_pylist(), names.to_pylist(), scores.tolist()) == (["S1-1", "S1-1"], ["d", "a"], [2.0, 1.0])


def test_all_pairs_keep_their_dictionary(spark, tmp_path):
    """Ids of candidates are written as places in a dictionary, also where there are more of them than one dictionary holds."""
    import pyarrow.parquet as pq

    entry = "transform(filter(sequence(0, 9), x -> pmod(xxhash64(id, x), 100) < 9), x -> struct(cast(x as string) as key, 1.0D as weight)) AS keys"
    others = spark.range(400_000, 600_000).selectExpr("'S2' AS source", "id AS rid", "concat('S2-', id) AS entity_id", entry).filter("size(keys) > 0")
    own = spark.range(30).selectExpr("'S1' AS source", "id AS rid", "concat('S1-', id) AS entity_id", "transform(sequence(0, 2), x -> struct(cast(pmod(id + x, 10) as string) as key, 1.0D as weight)) AS keys")
    P.pairs(own, others, None).write.option("parquet.block.size", 1 << 20).parquet(f"{tmp_path}/found")
    groups = [m.row_group(i) for m in (pq.ParquetFile(p).metadata for p in (tmp_path / "found").glob("*.parquet")) for i in range(m.num_row_groups)]
    assert groups and all("PLAIN" not in g.column(1).encodings for g in groups)
    shared = "SELECT a.entity_id AS a, b.entity_id AS b, size(array_intersect(a.keys.key, b.keys.key)) AS n FROM own a, others b"
    own.createOrReplaceTempView("own"), others.createOrReplaceTempView("others")
    expected = spark.sql(f"SELECT count(*), sum(n), sum(n * crc32(concat(a, b))) FROM ({shared}) WHERE n > 0")
    got = spark.read.parquet(f"{tmp_path}/found").selectExpr("count(*)", "sum(score)", "sum(score * crc32(concat(source1_entity_id, candidate_entity_id)))")
    assert tuple(got.first()) == tuple(expected.first())


def test_all_pairs_are_numbers_between_python_and_the_jvm(spark, monkeypatch):
    """A pair takes eight bytes on its way out of Python, whatever the length of its ids; ids are looked up where rows are made."""
    draw = random.Random(11)
    others = [(f"S{2 + i % 2}-{'x' * 40}{i:03d}", {key: draw.choice([1.0, 2.0, 70_000.0]) for key in draw.sample("abcdef", 2)}) for i in range(200)]
    own = [(f"S1-{'y' * 40}{j}", {key: 1.0 for key in draw.sample("abcdefg", 2)}) for j in range(50)]
    expected = {(a, b, b[:2], int(sum(has[key] * has_b[key] for key in has.keys() & has_b.keys()))) for a, has in own for b, has_b in others if has.keys() & has_b.keys()}
    frames = [spark.createDataFrame([(i[:2], i, i, [(k, w) for k, w in has.items()]) for i, has in rows], "source string, rid string, entity_id string, keys array<struct<key:string,weight:double>>") for rows in (own, others)]
    asked = [(a, list(has), list(has.values())) for a, has in own]
    for by_source in (True, False):
        found = P.search(*frames, None, by_source)
        blocks = [P._Block(r["data"], True) for r in found.blocks.collect()]
        assert [len(set(b.sources)) for b in blocks] == ([1, 1] if by_source else [2])
        for pairs in (1, 500, 1 << 15):
            monkeypatch.setattr(P, "PAIRS", pairs)
            made = [m for b in blocks for m in P._all_pairs(b, asked)]
            assert sum(len(m.column("packed").flatten()) for m in made) == len(expected)
            assert sum(m.column("packed").flatten().nbytes for m in made) == 8 * len(expected)
            got = P._unpacked(spark.createDataFrame([r for m in made for r in m.to_pylist()], "own array<string>, names array<string>, sources array<string>, packed array<bigint>")).collect()
            assert len(got) == len(expected) and set(map(tuple, got)) == expected
        rows = P.found(found).collect()
        assert len(rows) == len(expected) and set(map(tuple, rows)) == expected


def test_a_score_beyond_its_bits_is_an_error():
    """Scores that an INTEGER can't hold fail, as in SQL; none runs over into the places."""
    block = P._Block(block_of([("S2-1", {"x": 2.0**31 - 1, "y": 1.0})]), True)
    (made,) = P._all_pairs(block, [("S1-1", ["x"], [1.0])])
    assert made.column("packed").to_pylist() == [[2**31 - 1]]
    with pytest.raises(OverflowError):
        list(P._all_pairs(block, [("S1-1", ["x", "y"], [1.0, 1.0])]))
