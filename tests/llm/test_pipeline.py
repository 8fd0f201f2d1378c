from collections import Counter

import numpy as np
import pytest
from helpers import DOCUMENTS, SF, awkward, awkward_rows, empty, sentence
from pyspark.sql import functions as F
from test_jaccard import brute as components
from test_mixing import brute as mixture
from test_mixing import md5
from test_pii import brute as spans

import corpus_pipeline
from kindred.llm import mixing, pii, toxicity
from kindred.storage import materialize

CLASHING = ("toxicity_score", "quality_score", "pii_spans", "set_hash", "node", "label", "block", "place", "m_block", "row", "order", "alone", "copy", "key")


def counted(rows, columns):
    return Counter(tuple(str(r[c]) for c in columns) for r in rows)


def firsts(rows):
    """doc_ids that near-duplicate removal keeps: of each component the smallest, and all blank texts' own."""
    told = components([(r["doc_id"], r["text"]) for r in rows])
    blank = Counter(d for d, n, _ in told if n == 0)
    return Counter({c for _, n, c in told if n}) + blank


def packed_well(packed, docs):
    wanted = Counter(r["doc_id"] for r in docs)
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == wanted
    places = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, SF), name)
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
        if name == "near_duplicates":
            assert Counter(r["doc_id"] for r in docs.collect()) == firsts(before.collect())
        if name == "personal_data":
            assert docs.count() == before.count()
            assert not any(spans(r["text"] or "") for r in docs.collect())
        if name == "mixing":
            want = mixture([(r["doc_id"], r["text"], r["source"]) for r in before.collect()], mixing.MixingConfig())
            assert Counter((r["doc_id"], md5(r["text"] or "")) for r in docs.collect()) == Counter(r[:2] for r in want)
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()}
    packed_well(kept["packing"].collect(), kept["mixing"].collect())


@pytest.fixture(scope="module")
def quick(request):
    """Small networks in place of the trained ones: these tests are about rows."""
    patch = pytest.MonkeyPatch()
    patch.setattr(toxicity, "train", lambda sample, **_: toxicity.Network(1).prepare())
    patch.setattr(toxicity, "THRESHOLD", 1.1)
    network = pii.train([r[1] or "" for r in awkward_rows()], steps=60)
    patch.setattr(pii, "train", lambda texts, **_: network)
    yield
    patch.undo()


def labelled(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_awkward_tables(spark, quick, tmp_path, name, stage):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing columns, an empty table."""
    sf = labelled(spark, tmp_path, [(1, 0, 0), (5, 1, 1), (7, None, None), (None, 1, 1), (9, 0, 1)])
    docs = awkward(spark)
    for column in CLASHING:
        if column not in docs.columns:
            docs = docs.withColumn(column, F.lit(column))
    docs = docs.union(docs.filter("doc_id = 9").withColumn("doc_id", F.lit(20).cast("long")).withColumn("text", F.repeat("text", F.lit(40))))
    before = docs.collect()
    got = stage(spark, docs, sf)
    rows = got.collect()
    if name == "packing":
        packed_well(rows, before)
    else:
        assert got.columns == docs.columns
        if name == "near_duplicates":
            assert Counter(r["doc_id"] for r in rows) == firsts(before)
            assert not counted(rows, docs.columns) - counted(before, docs.columns)  # whole rows, as they were
        elif name == "mixing":
            assert {tuple(map(str, r)) for r in rows} == {tuple(map(str, r)) for r in before}
        else:
            rest = [c for c in docs.columns if c != "text"]
            assert counted(rows, rest) == counted(before, rest)
            assert Counter(r["text"] is None for r in rows) == Counter(r["text"] is None for r in before)
    nothing = stage(spark, empty(spark), sf)
    assert nothing.count() == 0


def test_toxic_rows_go(spark, quick, monkeypatch, tmp_path):
    sf = labelled(spark, tmp_path, [(1, 0, 0), (5, 1, 1), (9, 0, 1), (11, 0, 0)])
    docs = awkward(spark).withColumn("toxicity_score", F.lit("own"))
    scored = toxicity.toxicity_scores(docs, spark.read.parquet(f"{sf}/labels.parquet"), name="s").collect()
    middle = float(np.median([r["s"] for r in scored]))
    monkeypatch.setattr(toxicity, "THRESHOLD", middle)
    rows = corpus_pipeline.drop_toxic(spark, docs, sf).collect()
    assert counted(rows, docs.columns) == counted([r for r in scored if r["s"] < middle], docs.columns)
    assert 0 < len(rows) < len(scored)


def test_near_duplicates_are_rows(spark):
    """Two texts under one id, the near copy of a smaller id among them, and rows without an id."""
    text = sentence(200, 1)
    rows = [(3, text, "en", "a", 1), (5, text + " tail", "en", "a", 1), (5, sentence(150, 9), "en", "a", 1), (None, text + " end", "de", "b", 1),
            (None, sentence(90, 3), "de", "b", 2), (None, sentence(90, 3), "de", "a", 2), (8, sentence(70, 4), "fr", "z", 1), (8, sentence(70, 4), "en", "z", 1)]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCUMENTS), SF).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([(3, text), (5, sentence(150, 9)), (None, sentence(90, 3)), (8, sentence(70, 4))])
    assert {r["lang"] for r in got if r["doc_id"] == 8} == {"en"}  # {"lang":"en",...} comes before {"lang":"fr",...}


def test_personal_data_is_masked(spark, quick):
    df = spark.createDataFrame([(1, "mail a.b@c.org or 10.1.2.3 now", "en", "a", 1), (2, None, "en", "a", 1)], DOCUMENTS)
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.mask_personal_data(spark, df, SF).collect()}
    assert out[1].startswith("mail [EMAIL] or [IP]") and out[2] is None
