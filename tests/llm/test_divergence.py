import math
import re
from collections import defaultdict

import duckdb
import pytest
import regex
from helpers import DOCUMENTS, SF, awkward, awkward_rows, empty, sentence
from pyspark.sql import functions as F

from kindred.llm import divergence, queries

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    """Base counts from their definition, window by window."""
    text, words = text or "", split(text)
    lines = [x for x in text.split("\n") if split(x)]
    seen = defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    repeated = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), n < 20 or 100 * len(repeated) > 30 * n)


def histograms(text, key):
    left, classes = text or "", []
    for pattern in divergence.CHARACTER_CLASSES.values():
        rest = regex.sub(pattern, "", left)
        classes.append(len(left) - len(rest))
        left = rest
    words = split(text)
    return classes + [len(left)], [words.count(w) for w in divergence.COMMON_WORDS.get(key, [])]


def distance(p, q):
    side = lambda a, m: a * math.log2(a / m) if a > 0 else 0.0
    return math.sqrt(max(0.0, sum(side(a, (a + b) / 2) + side(b, (a + b) / 2) for a, b in zip(p, q)) / 2))


def brute(rows, config=divergence.DivergenceConfig()):
    """doc_id, base counts, kept of (doc_id, text, lang)."""
    scale, found = divergence.SCALE, []
    for doc_id, text, lang in rows:
        key = lang if lang in divergence.COMMON_WORDS else "other"
        classes, common = histograms(text, key)
        b = base(text)
        found.append((doc_id, b, key, classes, common, b[0] >= config.min_words and sum(classes) >= config.min_chars))
    references = {}
    for key in {f[2] for f in found}:
        mine = [f for f in found if f[2] == key and f[5] and not f[1][-1]]
        if len(mine) >= config.min_reference_docs:
            mean = lambda shares: [sum(x) / (len(mine) * scale) for x in zip(*shares)]
            references[key] = mean([[c * scale // sum(f[3]) for c in f[3]] for f in mine]), mean([[c * scale // f[1][0] for c in f[4]] for f in mine])
    out = []
    for doc_id, b, key, classes, common, judged in found:
        far = False
        if judged and key in references:
            of_classes, of_words = references[key]
            far = distance([c / sum(classes) for c in classes], of_classes) > config.max_class_distance
            if key != "other":
                p = [c / b[0] for c in common]
                far |= distance([*p, max(0.0, 1 - sum(p))], [*of_words, max(0.0, 1 - sum(of_words))]) > config.max_word_distance
        out.append((doc_id, *b, not b[-1] and not far))
    return sorted(out, key=str)


def run(df, config=divergence.DivergenceConfig()):
    return sorted((tuple(r) for r in divergence.divergence_rule(df, config).select("doc_id", *BASE, "kept").collect()), key=str)


def noisy(n=40):
    """Documents of two languages and an unknown one, some of them of quite other characters or words."""
    rows = []
    for i in range(n):
        rows.append((i, sentence(90, i), ["en", "de", "xx"][i % 3], "a", 1))
    for i in range(6):
        rows.append((100 + i, " ".join("Q9#%d$$" % (k * i) for k in range(80)), ["en", "xx"][i % 2], "a", 1))
        rows.append((200 + i, " ".join("zzyx%d" % (k % 37) + "abc" for k in range(70 + i)), "en", "a", 1))
    return rows


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    got = sorted((tuple(r[c] for c in ("doc_id", *BASE, "kept")) for r in queries.QUERIES["op2_divergence"](spark, SF).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("config", [divergence.DivergenceConfig(min_reference_docs=5), divergence.DivergenceConfig(min_reference_docs=1, max_class_distance=0.1, max_word_distance=0.1), divergence.DivergenceConfig(min_words=30, min_chars=50, min_reference_docs=3)])
def test_verdicts(spark, config):
    rows = noisy() + noisy()[:5]  # repeated rows are rows of their own
    got = run(spark.createDataFrame(rows, DOCUMENTS), config)
    assert got == brute([r[:3] for r in rows], config)
    assert {r[-1] for r in got} == {True, False}


def test_awkward_rows(spark):
    docs = awkward(spark)
    for name in ("classes", "key", "windows", "kept", "class_distance", "word_counts", "body"):
        docs = docs if name in docs.columns else docs.withColumn(name, F.lit("x"))
    got = run(docs, divergence.DivergenceConfig(min_reference_docs=1))
    assert got == brute([r[:3] for r in awkward_rows()], divergence.DivergenceConfig(min_reference_docs=1))


def test_sql_on_awkward_rows(spark, tmp_path):
    """The SQL twin judges the same rows alike, ties included."""
    rows = noisy() + noisy()[:3]
    spark.createDataFrame(rows, DOCUMENTS).coalesce(1).write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    told = con.execute(f"SELECT doc_id, {', '.join(BASE)}, kept FROM ({divergence.oracle_sql()})").fetchall()
    # repeated rows are told apart by nothing in SQL: their windows count together there
    once = {r[0] for r in rows if r[0] > 2}
    assert sorted((r for r in told if r[0] in once), key=str) == [r for r in brute([x[:3] for x in rows]) if r[0] in once]


def test_small_references_judge_nothing(spark):
    rows = [(i, " ".join("Q9#%d$$" % (k * i) for k in range(80)), "fr", "a", 1) for i in range(5)]
    got = run(spark.createDataFrame(rows, DOCUMENTS))
    assert [r[-1] for r in got] == [not r[-2] for r in got]


def test_empty_table(spark):
    assert divergence.divergence_rule(empty(spark)).count() == 0
