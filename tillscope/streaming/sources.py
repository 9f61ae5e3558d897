"""Streaming sources over landed tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tillscope.sources.tables import read_table


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """File stream of one landed table, a file or a (partitioned) folder; the
    schema is taken from the landed data."""
    schema = read_table(spark, sf_dir, name).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(sf_dir, f"{name}.parquet"))
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if folder:
        return r.parquet(path.toString())
    return r.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
