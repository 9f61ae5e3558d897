"""Latest row per key as a combinable aggregate.

``DISTINCT ON (k) ... ORDER BY k, ts DESC`` becomes ``max(struct(ts, id, ...))``
grouped by ``k``. The aggregate is combined map-side before the exchange, so a
key holding a third of all rows is reduced to one row per input partition
before it is shuffled. The struct makes it a sort aggregate: each task sorts
its own input by key, but no task buffers a whole hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _order_fields(order_by: Sequence[str], nulls_first: bool) -> list[Column]:
    fields: list[Column] = []
    for i, c in enumerate(order_by):
        if nulls_first:
            # True sorts after False, so NULL keys win a descending pick.
            fields.append(F.col(c).isNull().alias(f"_null{i}"))
        fields.append(F.col(c).alias(f"_ord{i}"))
    return fields


def latest_per(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    value_cols: Sequence[str] | None = None,
    nulls_first: bool = False,
) -> DataFrame:
    """One row per ``keys``: the row with the greatest ``order_by`` tuple.

    ``order_by`` should end with a unique id so ties are deterministic.
    ``nulls_first=True`` mimics a PostgreSQL ``ORDER BY ... DESC`` where NULL
    ranks first; the default (NULLS LAST) matches Spark's ``desc()``.
    """
    keys = list(keys)
    if value_cols is None:
        value_cols = [c for c in df.columns if c not in keys]
    order_pos = {c: i for i, c in enumerate(order_by)}
    # Values that are also ordering columns are read back from their ordering
    # field instead of being carried twice in the struct.
    extra = [c for c in value_cols if c not in order_pos]
    fields = _order_fields(order_by, nulls_first) + [F.col(c).alias(c) for c in extra]
    best = df.groupBy(*keys).agg(F.max(F.struct(*fields)).alias("_best"))
    out = [F.col("_best")[f"_ord{order_pos[c]}" if c in order_pos else c].alias(c) for c in value_cols]
    return best.select(*keys, *out)


def dedupe_by(df: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """Union-distinct by id: keep the last occurrence by ``order_by``."""
    return latest_per(df, [key], order_by, [c for c in df.columns if c != key]).select(*df.columns)
