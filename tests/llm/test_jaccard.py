import random
import re

import pytest
from helpers import SF, awkward, awkward_rows, empty, sentence

from kindred.llm import jaccard, queries
from kindred.llm.components import connected_components


def brute(rows):
    """doc_id, n_shingles, component_id by comparing every two sets."""
    sets = []
    for doc_id, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        n = len(words)
        sets.append({tuple(words[i : i + 5]) for i in range(n - 4)} if n >= 5 else {tuple(words)} if words else set())
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 75 * (len(a) + len(b) - both):
                    label[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        ids = [x for x in (least.get(root(i)), doc_id) if x is not None]
        least[root(i)] = min(ids) if ids else None
    return sorted(((d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def run(spark, rows, config=jaccard.JaccardConfig()):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in jaccard.jaccard_components(df, config).collect()), key=str)


def test_awkward_rows(spark):
    got = sorted((tuple(r) for r in jaccard.jaccard_components(awkward(spark)).collect()), key=str)
    assert got == brute([(r[0], r[1]) for r in awkward_rows()])


def test_empty_table(spark):
    assert jaccard.jaccard_components(empty(spark)).count() == 0


@pytest.mark.parametrize("blocks", [2, 5, 512])
def test_random_families(spark, blocks):
    """Copies, chains of near copies, passages shared by many, and small blocks so that every path is taken."""
    r = random.Random(blocks)
    rows, passages = [], [sentence(45, i).split() for i in range(3)]
    for family in range(12):
        base = sentence(r.choice([6, 30, 70, 150]), 100 + family).split()
        for k in range(r.choice([1, 3, 14])):
            words = list(base)
            for _ in range(r.choice([0, 1, 2, len(words) // 40 + 1])):
                words[r.randrange(len(words))] = "edit%d" % r.randrange(1000)
            if k % 4 == 3:
                base = words  # a chain
            if r.random() < 0.4:
                at = r.randrange(len(words))
                words = words[:at] + r.choice(passages) + words[at:]
            rows.append((len(rows), " ".join(words).upper() if k % 2 else " ".join(words)))
    rows += [(1000 + i, " ".join(passages[0] + ["own%d" % (10 * i + j) for j in range(12)])) for i in range(20)]
    config = jaccard.JaccardConfig(block_rows=blocks, block_bytes=4_000_000 if blocks > 2 else 2000, chunk_bytes=3000, verifying=blocks, range_tokens=50)
    assert run(spark, rows, config) == brute(rows)


def test_query_against_brute_force(spark):
    docs = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(x) for x in queries.QUERIES["op7_jaccard"](spark, SF).collect()), key=str)
    assert got == brute(docs)


def test_components_of_a_chain(spark):
    chain = list(range(40))
    random.Random(1).shuffle(chain)
    edges = spark.createDataFrame([*zip(chain, chain[1:]), (100, 101), (101, 101)], "a long, b long")
    got = {r["node"]: r["label"] for r in connected_components(edges).collect()}
    assert got == {**{x: 0 for x in chain}, 100: 100, 101: 100}
