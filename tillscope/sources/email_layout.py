"""Tables laid out by e-mail: joins of the login audits without a shuffle.

``land_by_email`` writes logins, carts and treatment plans with their
normalised e-mail as ``email_key``, bucketed and sorted by it, as tables of
the session's catalog over folders of the shared folder; ``open_by_email``
attaches the same folders in another session. An operator that finds an
``email_key`` column groups and joins by it, so its inputs, which agree on
buckets, meet where they lie.

A bucket is one task, so the layout only pays while no e-mail dominates:
``land_by_email`` counts first and refuses a table of which one bucket would
hold more than ``UNEVEN`` times its share (and ``LEAST_ROWS``); such tables stay
with the plain layout, whose aggregates combine before they shuffle.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.functions.emails import EMAIL_KEY, normalize_email
from tillscope.session import shared_dir

TABLES = ("logins", "carts", "treatment_plans")
#: Largest bucket, as a multiple of the mean, and the rows below which any is fine.
UNEVEN, LEAST_ROWS = 8, 1_000_000


class SkewedEmails(ValueError):
    """One bucket would hold too much of a table."""


def _names(version: str) -> dict[str, str]:
    return {t: f"{t}_by_email_{version}" for t in TABLES}


def _folder(spark: SparkSession, version: str, name: str, root: str | None) -> str:
    return os.path.join(root or os.path.join(shared_dir(spark), "tillscope", "by-email"), version, name)


def largest_bucket(df: DataFrame, buckets: int) -> tuple[int, float]:
    """Rows of the largest bucket, and the mean."""
    n = df.groupBy(F.pmod(F.hash(EMAIL_KEY), F.lit(buckets)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    most, total = n.agg(F.max("n"), F.sum("n")).first()
    return most or 0, (total or 0) / buckets


def land_by_email(spark: SparkSession, inputs, version: str, buckets: int, root: str | None = None) -> dict[str, DataFrame]:
    """Write the three tables of ``inputs`` in ``buckets`` buckets; a version
    landed again replaces itself. Returns the laid out tables."""
    for name, table in _names(version).items():
        df = getattr(inputs, name).withColumn(EMAIL_KEY, normalize_email("email"))
        most, mean = largest_bucket(df, buckets)
        if most > max(UNEVEN * mean, LEAST_ROWS):
            raise SkewedEmails(f"{name}: one of {buckets} buckets would hold {most} rows (mean {mean:.0f})")
        # One task a bucket writes one sorted file.
        w = df.repartition(buckets, EMAIL_KEY).write.mode("overwrite").bucketBy(buckets, EMAIL_KEY).sortBy(EMAIL_KEY)
        w.option("path", _folder(spark, version, name, root)).format("parquet").saveAsTable(table)
    return {name: spark.table(table) for name, table in _names(version).items()}


def open_by_email(spark: SparkSession, version: str, buckets: int, root: str | None = None) -> dict[str, DataFrame]:
    """The tables that another session landed."""
    for name, table in _names(version).items():
        path = _folder(spark, version, name, root)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
            f"CLUSTERED BY ({EMAIL_KEY}) SORTED BY ({EMAIL_KEY}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
    return {name: spark.table(table) for name, table in _names(version).items()}
