"""Similarities of strings and token lists as Column expressions, each from 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when((a == "") & (b == ""), F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longest.cast("double"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct members; 1 for two empty lists, 0 if one is empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def token_sort_ratio(a: Column, b: Column) -> Column:
    """levenshtein_ratio of the sorted tokens; repeats count."""
    return levenshtein_ratio(F.array_join(F.sort_array(a), " "), F.array_join(F.sort_array(b), " "))


def prefix_match(a: Column, b: Column, k: int = 3) -> Column:
    """1 if both are non-empty and agree in the first k characters."""
    return F.when((a != "") & (b != "") & (F.substring(a, 1, k) == F.substring(b, 1, k)), F.lit(1.0)).otherwise(F.lit(0.0))
