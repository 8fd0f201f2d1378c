"""Matching records of the first source as they arrive, against fixed sources two and three."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kindred.operators import blocking
from kindred.operators.records import normalized_records
from kindred.storage import materialize


def match_stream(arriving: DataFrame, others: DataFrame, sink: str, checkpoint: str, config: blocking.BlockingConfig = blocking.STANDARD) -> StreamingQuery:
    """arriving: a stream of records (source S1). Each batch's candidates go to sink/batch=<number> as Parquet, which
    a batch that runs again overwrites; the others are normalised, and their postings made, once."""
    fixed = materialize(normalized_records(others.filter("source <> 'S1'")), "others")
    index = materialize(blocking.posting_index(fixed, config), "postings")

    def one_batch(batch: DataFrame, number: int) -> None:
        records = fixed.unionByName(normalized_records(batch).select(*fixed.columns))
        blocking.candidates(records, config, index).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return arriving.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
