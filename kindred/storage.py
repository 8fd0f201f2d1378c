"""Tables that cut lineage: written once to the folder that all executors share, then read back."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where driver and executors are one process."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not (context.master.startswith("local") and "cluster" not in context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="kindred-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; what is there goes when the driver exits."""
    path = f"{shared_dir(spark)}/kindred-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and return it as read back: computed once, whoever is lost later.

    The shuffle files of this write go with it: nothing reads them again.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._kindred_path = path
    return back


def release(*tables: DataFrame) -> None:
    """Delete materialized tables whose last reader has been written. Others are left alone."""
    for table in tables:
        path = getattr(table, "_kindred_path", None)
        if path:
            _delete(table.sparkSession, path)
            _written[:] = [(s, p) for s, p in _written if p != path]


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_written() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone: the shared folder has its own clean-up
            return
