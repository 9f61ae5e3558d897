"""Sinks: JSON results (B7) and CSV reports (B8), partitioned by local day.

Paths should live in the cluster's shared folder (see
``tillscope.session.scratch_path``); writes are whole-job, so a lost
executor only re-runs its tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Timestamps are written with microseconds (the text formats' defaults keep
# only milliseconds, which would not round-trip).
TS_OPTIONS = {
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}


#: Rows of one output file at most (about 128 MB of order rows).
MAX_ROWS_PER_FILE = 1_000_000


def _writer(df: DataFrame, partition_by: str | None, mode: str):
    """A writer whose files follow the days' sizes: rows are rebalanced by the
    partition column (AQE splits a hot day and merges small ones), and only
    the days present in ``df`` are replaced."""
    if partition_by and partition_by in df.columns:
        w = df.hint("rebalance", partition_by).write.partitionBy(partition_by)
    else:
        w = df.write
    return w.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", MAX_ROWS_PER_FILE)


def write_json(df: DataFrame, path: str, partition_by: str | None = "local_date", mode: str = "overwrite") -> str:
    _writer(df, partition_by, mode).options(**TS_OPTIONS).json(path)
    return path


def write_csv(df: DataFrame, path: str, partition_by: str | None = "local_date", mode: str = "overwrite") -> str:
    """CSV with header; Spark quotes fields that need it (commas, quotes)."""
    _writer(df, partition_by, mode).options(**TS_OPTIONS).option("header", True).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite") -> str:
    _writer(df, partition_by, mode).parquet(path)
    return path


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """Read a JSON sink back with its schema (partition column from folders)."""
    return spark.read.schema(schema).options(**TS_OPTIONS).json(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).options(**TS_OPTIONS).option("header", True).csv(path)
