"""Text normalisation as Column expressions (built-in functions only, but for the exact accent fold)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions import constants as C

Fold = Callable[[Column], Column]


def _fold(text: str) -> str:
    """Compatibility decomposition without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@cache
def fold_table() -> tuple[str, str]:
    """Arguments of translate(): characters that fold to one other character, then those that fold to nothing."""
    source, target, gone = [], [], []
    for point in range(0x80, 0x10000):
        if 0xD800 <= point < 0xE000 or 0xAC00 <= point < 0xD7A4:
            continue
        char, folded = chr(point), _fold(chr(point))
        if folded == "":
            gone.append(char)
        elif len(folded) == 1 and folded != char:
            source.append(char)
            target.append(folded)
    return "".join(source + gone), "".join(target)


def fold_native(c: Column) -> Column:
    """Accent fold within the JVM. Characters that fold to two or more (ligatures, fractions, Hangul) stay."""
    return F.translate(c, *fold_table())


def fold_exact(c: Column) -> Column:
    """Accent fold for every character, in Arrow batches. Meant for records, never for pairs."""
    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else _fold(t))

    return fold(c)


def clean(c: Column, fold: Fold = fold_native) -> Column:
    """Folded, lower case; hyphen, slash, stop and every sign but & become white space; white space single."""
    c = F.translate(F.lower(fold(F.coalesce(c, F.lit("")))), "-/.", "   ")
    c = F.regexp_replace(c, r"(?U)[^\p{L}\p{N}_\s&]", " ")
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _words(cleaned: Column) -> Column:
    return F.filter(F.split(cleaned, " "), lambda w: w != "")


def name_words(cleaned: Column) -> Column:
    """Words of a cleaned name that are neither legal forms, generic terms, articles nor "and"."""
    dropped = [*C.NAME_REMOVED, C.NAME_AND, "&"]
    return F.filter(_words(cleaned), lambda w: ~w.isin(dropped))


def address_words(cleaned: Column) -> Column:
    """Words of a cleaned address in their short forms."""
    table = F.create_map(*[F.lit(x) for pair in C.ADDRESS_WORDS.items() for x in pair])
    return F.transform(_words(cleaned), lambda w: F.coalesce(F.try_element_at(table, w), w))


def normalize_name(c: Column, fold: Fold = fold_native) -> Column:
    return F.array_join(name_words(clean(c, fold)), " ")


def normalize_address(c: Column, fold: Fold = fold_native) -> Column:
    return F.array_join(address_words(clean(c, fold)), " ")


def name_tokens(normalized: Column) -> Column:
    """Words of a normalised name without stop words; order and repeats stay."""
    return F.filter(_words(normalized), lambda w: ~w.isin(C.NAME_STOPWORDS))


def address_tokens(normalized: Column) -> Column:
    return F.filter(_words(normalized), lambda w: ~w.isin(C.ADDRESS_STOPWORDS))


def postal_code(raw: Column) -> Column:
    """The first run of five or six digits that stands alone in the raw address; null without one."""
    return F.nullif(F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?U)\b\d{5,6}\b", 0), F.lit(""))


def strip_landmark(normalized: Column) -> Column:
    """Without everything from the first word "near" on."""
    return F.trim(F.regexp_replace(normalized, r"(?U)\bnear\b.*$", ""))


def char_ngrams(c: Column, n: int = 3) -> Column:
    """Distinct runs of n characters, blanks left out; the whole of a shorter text; nothing of an empty one."""
    bare = F.replace(c, F.lit(" "), F.lit(""))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(bare) - (n - 1), F.lit(1))), lambda i: F.substring(bare, i, F.lit(n)))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def name_prefix3(normalized: Column) -> Column:
    """Up to three first characters of the name without blanks."""
    return F.substring(F.replace(normalized, F.lit(" "), F.lit("")), 1, 3)


def first_token_prefix(normalized: Column) -> Column:
    """Three first characters of the first word; null if that is shorter."""
    first = F.split(normalized, " ")[0]
    return F.when(F.length(first) >= 3, F.substring(first, 1, 3))


def blocking_text(name: Column, address: Column) -> Column:
    return F.concat_ws(" ", F.nullif(name, F.lit("")), F.nullif(address, F.lit("")))


def normalize_country(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""))


def source_of_id(entity_id: Column) -> Column:
    return F.substring(entity_id, 1, 2)


def is_from(entity_id: Column, source: str) -> Column:
    return F.startswith(entity_id, F.lit(source + "-"))


