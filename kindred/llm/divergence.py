"""Distribution divergence (quality rule, DataFrame functions only).

Each document's character-class histogram and common-word histogram are compared with references for its
language by Jensen-Shannon distance. References are the means of the per-document shares over all documents of
the language that are long enough and pass the base rule, in whole millionths, so that their sums do not depend
on the order of addition.

Defined cases: a null or empty text has no words and fails the base rule; a language without a list of common
words (or null) is held against the pool of such languages by character classes alone; a reference of fewer than
``min_reference_docs`` documents judges nothing; a document under ``min_words`` words (or ``min_chars``
characters) is not judged by the divergence. Rows are judged one by one, so repeated rows stay repeated. Only
doc_id, text and lang are read: other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.storage import materialize

WORD_GAP = r"[\x20\x09-\x0D]+"
WINDOW = 8

# Frequent function words of each language (public knowledge of the languages, not taken from any corpus here).
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "on", "for", "was", "with", "be", "as", "by"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "una"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
}
# Removed one after the other; what is left at the end is the class "other".
CHARACTER_CLASSES = {
    "lower": r"[\p{Ll}\p{Lo}\p{Lm}\p{M}]+",
    "space": WORD_GAP,
    "upper": r"[\p{Lu}\p{Lt}]+",
    "digit": r"\p{Nd}+",
    "stop": r"""[.,;:!?'"()-]+""",
}
SCALE = 1_000_000


@dataclass(frozen=True)
class DivergenceConfig:
    max_class_distance: float = 0.25
    max_word_distance: float = 0.31
    min_words: int = 60
    min_chars: int = 200
    min_reference_docs: int = 20


def base_counts(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, language key, base counts and both histograms (arrays of long)."""
    supported = sorted(COMMON_WORDS)
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(
        "doc_id",
        F.when(F.col("lang").isin(supported), F.col("lang")).otherwise("other").alias("key"),
        text.alias("text"),
        F.btrim(text, F.lit(" \t\n\x0b\x0c\r")).alias("body"),
    )
    df = df.select("*", F.when(F.col("body") == "", F.array().cast("array<string>")).otherwise(F.split("body", WORD_GAP)).alias("words"))

    # residues of the text after each class is removed: every pass reads what the one before has left
    names, before = list(CHARACTER_CLASSES), "text"
    for name in names:
        df = df.withColumn(f"without_{name}", F.regexp_replace(before, CHARACTER_CLASSES[name], ""))
        before = f"without_{name}"
    lengths = [F.length(c).cast("long") for c in ("text", *(f"without_{n}" for n in names))]
    classes = F.array(*[a - b for a, b in zip(lengths, lengths[1:])], lengths[-1])
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")

    # hashes of 2, 4 and 8 words, each from the one before
    df = df.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    for width in (1, 2, 4):
        df = df.withColumn(f"h{2 * width}", _paired(f"h{width}", width))
    df = df.withColumn("windows", F.slice("h8", 1, F.greatest(F.size("words") - (WINDOW - 1), F.lit(0))))
    df = df.withColumn(
        "ranked",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at")))),
        ),
    )
    df = df.withColumn("repeats", F.filter("ranked", _same_as_neighbour("ranked")))
    df = df.withColumn("starts", F.sort_array(F.transform("repeats", lambda x: x["at"])))
    covered = F.transform("starts", lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("starts"), i + 1) - at, F.lit(WINDOW))))

    every_word = sorted({w for words in COMMON_WORDS.values() for w in words})
    df = df.withColumn("common", F.filter("words", lambda w: w.isin(every_word)))
    per_language = F.array().cast("array<bigint>")
    for language in supported:
        found = [(F.size("common") - F.size(F.array_remove("common", w))).cast("long") for w in COMMON_WORDS[language]]
        per_language = F.when(F.col("key") == language, F.array(*found)).otherwise(per_language)
    return df.select(
        "doc_id",
        "key",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - F.length("without_lower") + F.length("without_space")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("without_stop", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        _duplicates(lines).alias("n_dup_lines"),
        F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        classes.alias("classes"),
        per_language.alias("word_counts"),
    )


def _paired(column: str, width: int) -> Column:
    return F.transform(column, lambda h, i: F.xxhash64(h, F.get(F.col(column), i + width)))


def _same_as_neighbour(column: str):
    return lambda x, i: (F.get(F.col(column), i + 1)["h"] == x["h"]) | (F.get(F.col(column), i - 1)["h"] == x["h"])


def _duplicates(lines: Column) -> Column:
    return F.transform(F.array(lines), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))[0]


def divergence_rule(docs: DataFrame, config: DivergenceConfig = DivergenceConfig()) -> DataFrame:
    """doc_id, n_words, base counts, base_failed, kept, class_distance and word_distance (null where not judged)."""
    df = base_counts(docs)
    df = df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    df = df.withColumn("n_chars", F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x))
    df = materialize(df, "divergence")

    # at most len(COMMON_WORDS) + 1 rows: a bounded broadcast
    width = {"classes": len(CHARACTER_CLASSES) + 1, "words": len(COMMON_WORDS["en"])}
    judged = (F.col("n_words") >= config.min_words) & (F.col("n_chars") >= config.min_chars)
    share = {
        "classes": lambda i: F.floor(F.col("classes")[i] * SCALE / F.col("n_chars")),
        "words": lambda i: F.floor(F.coalesce(F.get("word_counts", F.lit(i)), F.lit(0)) * SCALE / F.col("n_words")),
    }
    sums = [F.sum(share[kind](i)).alias(f"{kind}_{i}") for kind in width for i in range(width[kind])]
    references = df.filter(judged & ~F.col("base_failed")).groupBy("key").agg(F.count("*").alias("n_reference"), *sums)
    references = references.filter(F.col("n_reference") >= config.min_reference_docs).select(
        "key",
        *[F.array(*[F.col(f"{kind}_{i}") / (F.col("n_reference") * float(SCALE)) for i in range(width[kind])]).alias(f"{kind}_reference") for kind in width],
    )
    df = df.join(F.broadcast(references), "key", "left")
    df = df.withColumn("class_share", F.transform("classes", lambda x: x / F.col("n_chars").cast("double")))
    df = df.withColumn("word_share", _with_rest(F.transform("word_counts", lambda x: x / F.col("n_words").cast("double"))))
    df = df.withColumn("class_distance", F.when(judged, _distance(F.col("class_share"), F.col("classes_reference"))))
    df = df.withColumn("word_distance", F.when(judged & (F.col("key") != "other"), _distance(F.col("word_share"), _with_rest(F.col("words_reference")))))
    too_far = (F.coalesce("class_distance", F.lit(0.0)) > config.max_class_distance) | (F.coalesce("word_distance", F.lit(0.0)) > config.max_word_distance)
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~too_far).alias("kept"), "class_distance", "word_distance",
    )


def _with_rest(shares: Column) -> Column:
    """Shares and what they leave of 1 (not below 0)."""
    rest = lambda x: F.greatest(F.lit(0.0), F.lit(1.0) - F.aggregate(x, F.lit(0.0), lambda a, y: a + y))
    return F.transform(F.array(shares), lambda x: F.concat(x, F.array(rest(x))))[0]


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance with logarithms to base 2: 0 for equal, 1 for disjoint distributions."""
    side = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: side(a, (a + b) / 2) + side(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda x, y: x + y) / 2))


def oracle_sql(config: DivergenceConfig = DivergenceConfig()) -> str:
    """The same rule for DuckDB over the view documents."""
    names, steps, before = list(CHARACTER_CLASSES), [], "text"
    for name in names:
        pattern = CHARACTER_CLASSES[name].replace("'", "''")
        steps.append(f"s_{name} AS (SELECT *, regexp_replace({before}, '{pattern}', '', 'g') AS r_{name} FROM {'d' if before == 'text' else 's_' + before[2:]})")
        before = f"r_{name}"
    lengths = ["length(text)", *(f"length(r_{n})" for n in names)]
    classes = ", ".join([f"{a} - {b}" for a, b in zip(lengths, lengths[1:])] + [lengths[-1]])
    quoted = lambda words: ", ".join("'" + w + "'" for w in words)
    by_key = " ".join(
        f"WHEN '{k}' THEN [{', '.join(f'len(list_filter(words, lambda x: x = {chr(39)}{w}{chr(39)}))' for w in words)}]" for k, words in sorted(COMMON_WORDS.items())
    )
    n_class, n_word = len(names) + 1, len(COMMON_WORDS["en"])
    sums = ", ".join(
        [f"sum(floor(classes[{i + 1}] * {SCALE}::DOUBLE / n_chars)) / (count(*) * {SCALE}::DOUBLE)" for i in range(n_class)]
    )
    word_sums = ", ".join([f"sum(floor(coalesce(word_counts[{i + 1}], 0) * {SCALE}::DOUBLE / n_words)) / (count(*) * {SCALE}::DOUBLE)" for i in range(n_word)])
    side = lambda a, m: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / {m}) ELSE 0 END"
    distance = lambda p, q: (
        f"sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: {side(f'{p}[i]', f'(({p}[i] + {q}[i]) / 2)')} + {side(f'{q}[i]', f'(({p}[i] + {q}[i]) / 2)')})) / 2))"
    )
    rest = lambda x: f"list_append({x}, greatest(0, 1 - list_sum({x})))"
    return f"""
WITH d AS (SELECT doc_id, CASE WHEN lang IN ({quoted(sorted(COMMON_WORDS))}) THEN lang ELSE 'other' END AS key, coalesce(text, '') AS text FROM documents),
{', '.join(steps)},
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{WORD_GAP}'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM s_{names[-1]}),
v AS (SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM v) WHERE n > 1),
c AS (SELECT doc_id, sum(step) AS n FROM (SELECT doc_id, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {WINDOW})) AS step FROM r) GROUP BY doc_id),
t AS (SELECT w.doc_id, key, len(words) AS n_words, length(text) AS n_chars, length(text) - length(r_lower) + length(r_space) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, [{classes}] AS classes, CASE key {by_key} ELSE []::BIGINT[] END AS word_counts
    FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_words >= {config.min_words} AND n_chars >= {config.min_chars} AS judged FROM t),
f AS (SELECT key, [{sums}] AS class_ref, [{word_sums}] AS word_ref FROM b WHERE judged AND NOT base_failed GROUP BY key HAVING count(*) >= {config.min_reference_docs}),
p AS (SELECT b.*, list_transform(classes, lambda x: x / n_chars::DOUBLE) AS class_p, class_ref AS class_q,
    {rest('list_transform(word_counts, lambda x: x / n_words::DOUBLE)')} AS word_p, {rest('word_ref')} AS word_q FROM b LEFT JOIN f USING (key)),
j AS (SELECT *, CASE WHEN judged THEN {distance('class_p', 'class_q')} END AS class_distance,
    CASE WHEN judged AND key <> 'other' THEN {distance('word_p', 'word_q')} END AS word_distance FROM p)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    n_repeat_words, base_failed, NOT base_failed AND NOT (coalesce(class_distance, 0) > {config.max_class_distance} OR coalesce(word_distance, 0) > {config.max_word_distance}) AS kept
FROM j"""
