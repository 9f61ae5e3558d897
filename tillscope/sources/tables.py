"""Landed-table scans (Parquet; column pruning and pushdown by Catalyst)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one landed table ``<sf_dir>/<name>.parquet`` (file or folder)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_landed(spark: SparkSession, paths: list[str], fmt: str = "parquet", schema=None) -> DataFrame:
    """Many landed pages or days as one relation (multi-path read)."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(paths)
