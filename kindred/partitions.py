"""How many partitions the pairs of S1 with the other sources get, and whether those are small enough to be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Records of S1 whose pairs one task holds. Pairs grow far beyond the bytes by which Spark itself would choose.
RECORDS_PER_TASK = 256


def local_parts(records: DataFrame, broadcast_bytes: int) -> int | None:
    """Partitions of S1 to meet a broadcast of the other sources; None if their names and addresses have more than
    broadcast_bytes. A record has fewer words than bytes, so these bound the broadcast too."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("business_name", "business_address")), F.lit(0))
    other = F.coalesce(F.sum(F.when(F.col("source") != "S1", size)), F.lit(0))
    row = records.agg(F.count_if(F.col("source") == "S1").alias("own"), other.alias("bytes")).first()
    if row["bytes"] > broadcast_bytes:
        return None
    spark = records.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-row["own"] // RECORDS_PER_TASK))
