import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from helpers import SF, awkward, awkward_rows, empty, sentence

from kindred.llm import mixing, queries


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def weights(tokens, k):
    z = [t ** (k / 1e6) for t in tokens]
    return [x / sum(z) for x in z]


def entropy(w):
    return -sum(x * math.log(x) for x in w)


def exponent(tokens, config):
    """By halving, over whole millionths: the largest that meets the entropy, but not below the least within the limit."""
    if len(tokens) < 2 or min(tokens) == max(tokens):
        return 10**6
    total = sum(tokens)
    own = entropy([t / total for t in tokens])
    target = own + config.entropy_gain * (math.log(len(tokens)) - own)

    def times(k):
        w = weights(tokens, k)
        budget = max(t / x for t, x in zip(tokens, w)) if config.budget_share is None else min(config.budget_share, config.repetition_limit) * total
        return max(budget * x / t for t, x in zip(tokens, w))

    low, high = 0, 10**6  # low meets the entropy
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if entropy(weights(tokens, middle)) >= target else (low, middle)
    meets = high if entropy(weights(tokens, high)) >= target else low
    low, high = -1, 10**6  # high is within the limit
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if times(middle) <= config.repetition_limit * (1 + 1e-12) else (middle, high)
    return max(meets, high)


def brute(rows, config):
    """All rows of the mixture of (doc_id, text, source), by sorting whole streams."""
    docs = list({(d, md5(t or ""), s): words(t) for d, t, s in rows}.items())
    tokens = Counter()
    for (_, _, s), n in docs:
        tokens[s] += n
    tokens = {s: n for s, n in tokens.items() if n}
    quota = {}
    if tokens:
        k = exponent(list(tokens.values()), config)
        w = dict(zip(tokens, weights(list(tokens.values()), k)))
        total = sum(tokens.values())
        budget = max(tokens[s] / w[s] for s in tokens) if config.budget_share is None else min(config.budget_share, config.repetition_limit) * total
        quota = {s: math.floor(budget * w[s] + 0.5) for s in tokens}
    blocks = max(1, math.floor(sum(quota.values()) / config.block_tokens + 0.5), -(-len(docs) // mixing.BLOCK_ROWS))

    def key(doc, copy, seed):
        return md5(f"{seed}:{copy}:{'' if doc[0] is None else doc[0]}:{doc[1]}")

    placed = []
    for s in tokens:
        at, copy = 0, 1
        while at < quota[s]:
            for doc, n in sorted((x for x in docs if x[0][2] == s and x[1]), key=lambda x: key(x[0], copy, config.seed)):
                if at < quota[s]:
                    placed.append((doc, copy, n, min(math.floor(at / (quota[s] / blocks)), blocks - 1)))
                at += n
            copy += 1
    placed += [(doc, 1, 0, int(key(doc, 1, config.seed)[:8], 16) * blocks // 2**32) for doc, n in docs if not n]
    by_block = defaultdict(list)
    for x in placed:
        by_block[x[3]].append(x)
    out = []
    for block, found in by_block.items():
        found.sort(key=lambda x: key(x[0], x[1], config.seed + 1))
        out += [(doc[0], doc[1], doc[2], copy, n, block, i + 1) for i, (doc, copy, n, _) in enumerate(found)]
    return sorted(out, key=str)


def run(df, config):
    return sorted((tuple(r) for r in mixing.mixture(df, config).collect()), key=str)


def table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df, [tuple(r) for r in df.select("doc_id", "text", "source").collect()]


def test_query(spark):
    _, docs = table(spark)
    got = sorted((tuple(r) for r in queries.QUERIES["op3_mixing"](spark, SF).collect()), key=str)
    want = brute(docs, mixing.PRODUCTION)
    assert got == sorted([(r[0], *r[2:]) for r in want], key=str)
    assert {r[0] for r in got} == {d for d, _, _ in docs}  # the budget drops no document here


@pytest.mark.parametrize("config", [
    mixing.MixingConfig(block_tokens=9000, repetition_limit=1.7),
    mixing.MixingConfig(block_tokens=5000, entropy_gain=0.9, repetition_limit=50.0),
    mixing.MixingConfig(block_tokens=3000, entropy_gain=0.3, repetition_limit=3.0, budget_share=2.2),
    mixing.MixingConfig(block_tokens=3000, budget_share=0.4),
])
def test_quotas_blocks_and_places(spark, config, monkeypatch):
    """Small buckets and groups, so that all levels of the prefix sums are at work."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 5)
    monkeypatch.setattr(mixing, "GROUP_BUCKETS", 4)
    df, docs = table(spark)
    got = run(df, config)
    assert got == brute(docs, config)
    assert len({r[5] for r in got}) > 5


SOURCES = [("a", 1000), ("b", 300), (None, 100), ("", 20)]


@pytest.mark.parametrize("gain", [0.1, 0.5, 0.8])
def test_target_entropy_is_met(spark, gain):
    totals = spark.createDataFrame(SOURCES, "key string, tokens long")
    config, tokens = mixing.MixingConfig(entropy_gain=gain, repetition_limit=1000.0), [t for _, t in SOURCES]
    k = mixing.find_exponent(totals, config)
    own = entropy([t / sum(tokens) for t in tokens])
    assert k == exponent(tokens, config) and 0 < k < 10**6
    assert math.isclose(entropy(weights(tokens, k)), own + gain * (math.log(4) - own), abs_tol=1e-5)


def test_limit_comes_before_entropy(spark):
    totals = spark.createDataFrame([("a", 1000), ("b", 10)], "key string, tokens long")
    k = mixing.find_exponent(totals, mixing.MixingConfig(entropy_gain=1.0, repetition_limit=2.0))
    assert math.isclose(k / 1e6, 1 - math.log(2) / math.log(100), abs_tol=1e-6)
    out, _ = mixing.quotas(totals, mixing.MixingConfig(entropy_gain=1.0, repetition_limit=2.0), 2)
    assert {r["key"]: Fraction(r["quota"], r["tokens"]) for r in out.collect()} == {"a": 1, "b": 2}


def test_null_source_is_its_own(spark):
    rows = [(i, sentence(30, i), s) for i, s in enumerate([None, "", None, "", "a", "a", "a", "a", "a"])]
    got = run(spark.createDataFrame(rows, "doc_id long, text string, source string"), mixing.MixingConfig())
    assert got == brute(rows, mixing.MixingConfig())
    assert {r[2] for r in got} == {None, "", "a"}


def test_awkward_rows(spark):
    docs = awkward(spark)
    for config in (mixing.MixingConfig(), mixing.PRODUCTION):
        assert run(docs, config) == brute([(r[0], r[1], r[3]) for r in awkward_rows()], config)


def test_mixed_keeps_rows_in_the_mixture_s_order(spark):
    from pyspark.sql import functions as F

    docs = awkward(spark).withColumn("m_block", F.lit("x")).withColumn("block", F.lit("y")).withColumn("copy", F.lit("z"))
    out = mixing.mixed(docs, mixing.MixingConfig(block_tokens=200))
    assert out.columns == docs.columns
    rows = out.collect()
    want = brute([(r[0], r[1], r[3]) for r in awkward_rows()], mixing.MixingConfig(block_tokens=200))
    times = Counter((r[0], r[1] or "", r[2], r[3]) for r in awkward_rows())
    places = {}
    for r in want:
        places.setdefault((r[0], r[1], r[2]), []).append(r[5:])
    expected = Counter()
    for (doc_id, text, lang, source), n in times.items():
        expected[doc_id, text, lang] += n * len(places[doc_id, md5(text), source])
    assert Counter((r["doc_id"], r["text"] or "", r["lang"]) for r in rows) == expected
    # a block's rows stand together, in the order of places
    order = [places[r["doc_id"], md5(r["text"] or ""), r["source"]] for r in rows]
    single = [p[0] for p in order if len(p) == 1]
    firsts = list(dict.fromkeys(b for b, _ in single))
    assert [b for b, _ in sorted(single, key=lambda p: firsts.index(p[0]))] == [b for b, _ in single]
    for b in firsts:
        inside = [p for x, p in single if x == b]
        assert inside == sorted(inside)


def test_empty_table_and_blank_texts(spark):
    assert mixing.mixture(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0
    rows = [(1, None, "a"), (1, "", "a"), (2, " ", None)]
    got = run(spark.createDataFrame(rows, "doc_id long, text string, source string"), mixing.PRODUCTION)
    assert got == brute(rows, mixing.PRODUCTION) and len(got) == 2
