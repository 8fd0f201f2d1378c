"""kindred: a Spark-first record-linkage and corpus-preparation engine."""

__version__ = "0.1.0"
