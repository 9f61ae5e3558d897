"""The order table kept current: one row a number, partitioned by UTC day.

The feed re-sends orders (two overlapping fetches, amended copies), so a new
delivery is merged by number into the days of its orders; other days are
neither read nor rewritten. ``created`` is when an order was placed and never
changes, so all copies of an order fall on one day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.functions.timez import UTC_DATE
from tillscope.operators.dedupe import dedupe_by
from tillscope.sources.sinks import write_parquet


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    """The current orders with their ``utc_date`` (prunes day ranges)."""
    return spark.read.parquet(path)


def upsert_orders(spark: SparkSession, path: str, delivery: DataFrame, order: Sequence[str]) -> list:
    """Merge ``delivery`` into the table at ``path``; of a number's copies the
    one with the greatest ``order`` columns (then ``created``) stays. Returns
    the days rewritten.

    Only the days of the delivery are read (partition filters) and replaced
    (dynamic partition overwrite); a run that fails leaves the days as they
    were or as merged, and running it again gives the same table. Rows without
    a ``created`` time belong to the null day.
    """
    new = delivery.withColumn(UTC_DATE, F.to_date("created"))
    days = [r[0] for r in new.select(UTC_DATE).distinct().collect()]  # a row a touched day
    if not days:
        return []
    if _exists(spark, path):
        touched = F.col(UTC_DATE).isin([d for d in days if d is not None])
        old = read_orders(spark, path).where(touched | F.col(UTC_DATE).isNull() if None in days else touched)
        new = old.select(*new.columns).unionByName(new)
    write_parquet(dedupe_by(new, "number", [*order, "created"]), path, partition_by=UTC_DATE)
    return sorted(d for d in days if d is not None)
