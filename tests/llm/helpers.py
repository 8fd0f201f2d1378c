"""Awkward document tables and brute-force versions that the tests share."""

import os
import random

SF = os.environ.get("KINDRED_TEST_SF", "/root/testdata/sf0.001")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"

random.seed(7)
_VOCABULARY = "the of and to in a is that it on for was with be as by une der und que".split() + ["w%d" % i for i in range(60)]


def sentence(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(_VOCABULARY) for _ in range(n))


def awkward_rows():
    """Nulls in every column, empty and blank texts, ties, repeated rows, one long text, odd white space."""
    long_text = "\n".join(sentence(40, i) for i in range(120))
    return [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \t\n ", None, None, 4),
        (4, "word", "xx", "b", 4),
        (5, "one two three four five", "en", "b", 23),
        (6, "one two three four five", "en", "b", 23),
        (7, sentence(200, 1), "en", "a", 1),
        (7, sentence(200, 1), "en", "a", 1),
        (8, sentence(200, 1) + " tail", "de", "a", 1),
        (9, long_text, "fr", "c", 1),
        (10, "a  b   c \n \n d e f \x1c g <|endoftext|> don't 123 ñandú \U0001f600 \r\n", "es", "c", 1),
        (11, "x" * 5000, "en", "c", 5000),
        (12, ("same line again and again and once more\n") * 30, "en", "c", 1),
        (None, "a row without an id", "en", None, None),
    ]


def awkward(spark, extra=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward_rows(), DOCUMENTS)
    if extra:  # columns whose names clash with names used within the operators
        for name in ("part", "number", "key", "words", "start", "payload", "score", "n", "shard", "hash", "length"):
            df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
