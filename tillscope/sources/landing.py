"""Landing job: a conformed copy of the event log.

The property bag ``props`` is JSON text; the landed copy holds its ``k`` field
as a typed column, so the parse is done once for all audits. It is partitioned
by the UTC event date (``utc_date``), which the fixtures carry through, and
sorted by ``ts`` within files, so a local-day range prunes whole partitions
and row groups.

Landing is an explicit job: queries never land anything, they read a copy
that they are given (``Fixtures(spark, sf_dir, events=path)``).
"""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.functions.timez import UTC_DATE
from tillscope.session import shared_dir

#: Source bytes that one written slice of time holds.
SLICE_BYTES = 128 << 20


def source_bytes(spark: SparkSession, path: str) -> int:
    """Bytes under ``path``, at any depth (one call to the file system)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def conformed(events: DataFrame) -> DataFrame:
    """``events`` with ``k`` parsed to INT, ``props`` dropped and the UTC date."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return events.withColumn("k", k).drop("props").withColumn(UTC_DATE, F.to_date("ts"))


def land_events(
    spark: SparkSession, sf_dir: str, version: str, root: str | None = None, slice_bytes: int = SLICE_BYTES
) -> str:
    """Write the conformed event log of ``sf_dir``; returns its path.

    ``version`` names the state of the source (the caller knows when it
    changed; neither sizes nor times on an object store tell) and is the
    folder's name under ``root`` (default: the shared folder), so a version
    landed again replaces itself. The number of time slices follows the
    source's bytes. Errors while looking at the source are raised.
    """
    src = os.path.join(sf_dir, "events.parquet")
    slices = max(1, math.ceil(source_bytes(spark, src) / slice_bytes))
    path = os.path.join(root or os.path.join(shared_dir(spark), "tillscope", "landed"), version, "events")
    # Range-partition on ts: each task writes a contiguous time slice, so files
    # stay balanced even when one day is hot.
    (
        conformed(spark.read.parquet(src))
        .repartitionByRange(slices, "ts")
        .sortWithinPartitions("ts")
        .write.mode("overwrite")
        .partitionBy(UTC_DATE)
        .parquet(path)
    )
    return path
