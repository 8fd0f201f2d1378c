"""Golden values and properties of the scalar functions."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from kindred.functions import similarity as S
from kindred.functions import text as T

NAMES = [
    ("Café Noir Pvt. Ltd.", "cafe noir", ["cafe", "noir"]), ("The AT&T Company", "at&t", ["at&t"]), ("Smith and Sons", "smith sons", ["smith", "sons"]),
    ("S.A. Motors", "s a motors", ["s", "motors"]), ("Global Tech Solutions Inc", "", []), ("India Post", "india post", ["post"]),
    ("O'Neil-Brown", "o neil brown", ["o", "neil", "brown"]), (None, "", []), ("ACME  acme", "acme acme", ["acme", "acme"]),
]


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_names(spark):
    df = spark.createDataFrame([(i, n) for i, (n, _, _) in enumerate(NAMES)], "i int, x string").withColumn("n", T.normalize_name(F.col("x")))
    got = {r["i"]: (r["n"], r["t"]) for r in df.withColumn("t", T.name_tokens(F.col("n"))).collect()}
    assert [got[i] for i in range(len(NAMES))] == [(n, t) for _, n, t in NAMES]


def test_address(spark):
    raw = "12/B, M.G. Road, Opp. City Mall, Pune 411001"
    df = spark.createDataFrame([(raw,)], "x string").withColumn("n", T.normalize_address(F.col("x")))
    r = df.select("n", T.strip_landmark(F.col("n")).alias("s"), T.address_tokens(F.col("n")).alias("t"), T.postal_code(F.col("x")).alias("p")).first()
    assert tuple(r) == ("12 b m g rd near city mall pune 411001", "12 b m g rd", ["12", "g", "mall", "pune", "411001"], "411001")
    for text, tokens in (("Flat 5, North Block", ["flat"]), ("a & b Street", ["&"])):
        assert one(spark, lambda c: T.address_tokens(T.normalize_address(c)), text) == tokens


@pytest.mark.parametrize("raw, code", [("PIN560001", None), ("560 001", None), ("1234567", None), ("Unit_12345", None), ("75001 Paris", "75001"), ("12345-6789", "12345"), (None, None)])
def test_postal(spark, raw, code):
    assert one(spark, T.postal_code, raw) == code


@pytest.mark.parametrize("text, grams", [("ab c", ["abc"]), ("ab", ["ab"]), ("", []), ("aaaa", ["aaa"]), ("abcd", ["abc", "bcd"])])
def test_ngrams(spark, text, grams):
    assert one(spark, T.char_ngrams, text) == grams


def test_folds(spark):
    r = random.Random(3)
    texts = ["".join(chr(r.choice([*range(0x20, 0x250), *range(0x1E00, 0x1F00), 0x300, 0x301, 0xFB01, 0xBD, 0xAC00])) for _ in range(20)) for _ in range(200)]
    expected = ["".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in texts]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.fold_exact(F.col("x")).alias("e"), T.fold_native(F.col("x")).alias("n")).collect()
    by = {x["x"]: x for x in rows}
    assert [by[t]["e"] for t in texts] == expected
    for t, e in zip(texts, expected):
        if all(len(T._fold(c)) <= 1 for c in t) and not any(unicodedata.combining(c) for c in t):
            assert by[t]["n"] == e


def test_normalising_twice_changes_nothing(spark):
    df = spark.createDataFrame([(n,) for n, _, _ in NAMES if n], "x string").withColumn("a", T.normalize_name(F.col("x")))
    assert df.withColumn("b", T.normalize_name(F.col("a"))).filter("a <> b").count() == 0


def python_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_similarities(spark):
    r = random.Random(5)
    pairs = [("kitten", "sitting"), ("", ""), ("", "x")] + [tuple("".join(r.choice("abé ß") for _ in range(r.randrange(9))) for _ in "ab") for _ in range(100)]
    df = spark.createDataFrame([(a, b, a.split(), b.split()) for a, b in pairs], "a string, b string, ta array<string>, tb array<string>")
    lev, jac, srt, pre = (lambda x, y: S.levenshtein_ratio(F.col(x), F.col(y))), (lambda x, y: S.jaccard(F.col(x), F.col(y))), (lambda x, y: S.token_sort_ratio(F.col(x), F.col(y))), (lambda x, y: S.prefix_match(F.col(x), F.col(y)))
    rows = df.select("*", lev("a", "b").alias("l"), lev("b", "a").alias("l2"), jac("ta", "tb").alias("j"), jac("tb", "ta").alias("j2"), srt("ta", "tb").alias("s"), pre("a", "b").alias("p")).collect()
    for x in rows:
        a, b, ta, tb = x["a"], x["b"], x["ta"], x["tb"]
        assert x["l"] == x["l2"] == pytest.approx(1 - python_distance(a, b) / max(len(a), len(b), 1))
        union = set(ta) | set(tb)
        assert x["j"] == x["j2"] == pytest.approx(len(set(ta) & set(tb)) / len(union) if union else 1.0)
        sa, sb = " ".join(sorted(ta)), " ".join(sorted(tb))
        assert x["s"] == pytest.approx(1 - python_distance(sa, sb) / max(len(sa), len(sb), 1))
        assert x["p"] == float(bool(a and b and a[:3] == b[:3]))
