"""Normalised records: everything that pairs need, computed once for each record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import text as T


def normalized_records(source: DataFrame, fold: T.Fold = T.fold_exact) -> DataFrame:
    """source: source, entity_id, business_name, business_address, country and, if there is one, a bigint rid.

    Adds name_norm, name_toks, name_prefix3, first_prefix, addr_norm, addr_strip, addr_toks, postal, blocking_text,
    country_norm. Without rid a hash of the id serves as the joins' key. Accents are folded exactly, once for each record.
    """
    df = source if "rid" in source.columns else source.withColumn("rid", F.xxhash64("entity_id"))
    df = df.withColumns({"name_norm": T.normalize_name(F.col("business_name"), fold), "addr_norm": T.normalize_address(F.col("business_address"), fold)})
    return df.withColumns({
        "name_toks": T.name_tokens(F.col("name_norm")),
        "name_prefix3": T.name_prefix3(F.col("name_norm")),
        "first_prefix": T.first_token_prefix(F.col("name_norm")),
        "addr_toks": T.address_tokens(F.col("addr_norm")),
        "addr_strip": T.strip_landmark(F.col("addr_norm")),
        "postal": T.postal_code(F.col("business_address")),
        "blocking_text": T.blocking_text(F.col("name_norm"), F.col("addr_norm")),
        "country_norm": T.normalize_country(F.col("country")),
    })
