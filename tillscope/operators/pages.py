"""A25 page by page: a sorted view's next page without sorting the view again.

``cluster_view`` writes the view once in its order, with a ``row_id`` that
rises along it (part of the range sort, then place in the part), and the parts'
sizes. A page is then a few ranges of ``row_id``: literal bounds that prune
files and row groups. The last row's ``row_id`` is the token for the page after
it, so rows with equal keys, ties and NULLs are neither lost nor shown twice.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_ID = "row_id"
_PLACES = 1 << 33  # places of a part in monotonically_increasing_id


def cluster_view(df: DataFrame, path: str, key: str, ascending: bool = False, tie_key: str | None = None) -> str:
    """Write ``df`` in the order of ``report.audit_sort`` (NULLS LAST)."""
    order = [F.col(key).asc_nulls_last() if ascending else F.col(key).desc_nulls_last()]
    if tie_key and tie_key != key:
        order.append(F.col(tie_key).asc_nulls_last())
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(ROW_ID, F.monotonically_increasing_id())
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    written = df.sparkSession.read.parquet(f"{path}/rows")
    sizes = written.groupBy(F.floor(F.col(ROW_ID) / _PLACES).cast("long").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    sizes.write.mode("overwrite").parquet(f"{path}/parts")
    return path


def page(spark: SparkSession, path: str, size: int, after: int | None = None, skip: int = 0) -> DataFrame:
    """The ``size`` rows after the row ``after`` (None: from the start), or after
    ``skip`` more, with their ``row_id``, in order."""
    parts = sorted(map(tuple, spark.read.parquet(f"{path}/parts").select("part", "n").collect()))  # a row a part of the sort
    part, at = divmod(after, _PLACES) if after is not None else (-1, -1)
    ranges, left = [], size
    for p, n in parts:
        if p < part or not left:
            continue
        first = at + 1 if p == part else 0
        jump = min(skip, max(n - first, 0))
        skip, first = skip - jump, first + jump
        take = min(left, n - first)
        if take > 0:
            ranges.append((p * _PLACES + first, p * _PLACES + first + take - 1))
            left -= take
    rows = spark.read.parquet(f"{path}/rows")
    # Parts that a page takes whole follow each other: their ranges are one.
    wanted = [F.col(ROW_ID).between(*r) for r in _merged(ranges, dict(parts))]
    return rows.where(functools.reduce(operator.or_, wanted, F.lit(False))).orderBy(ROW_ID)


def _merged(ranges: list[tuple[int, int]], sizes: dict[int, int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in ranges:
        if out and lo % _PLACES == 0 and out[-1][1] % _PLACES == sizes[out[-1][1] // _PLACES] - 1:
            out[-1] = (out[-1][0], hi)  # nothing lies between the end of a part and the next
        else:
            out.append((lo, hi))
    return out
