"""Join building blocks that Spark lacks as a single operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def band_keys(right: DataFrame, right_date: str, key: str, left_date: str, lo_days: int, hi_days: int) -> DataFrame:
    """Distinct (left_date, key) pairs that some ``right`` row satisfies with
    ``left_date - right_date`` in ``[lo_days, hi_days]``, flagged ``_hit``."""
    if hi_days < lo_days:
        raise ValueError("empty band")
    # Reduced to distinct (date, key) before each is spread over the band.
    r = right.select(right_date, key).distinct().select(
        F.explode(F.sequence(F.lit(lo_days), F.lit(hi_days))).alias("_off"), right_date, key
    ).select(F.date_add(right_date, F.col("_off")).alias(left_date), key)
    return r.distinct().withColumn("_hit", F.lit(True))


def band_semi_join(
    left: DataFrame,
    right: DataFrame,
    left_date: str,
    right_date: str,
    key: str,
    lo_days: int,
    hi_days: int,
    how: str = "left_semi",
) -> DataFrame:
    """Rows of ``left`` having a ``right`` row with the same ``key`` and
    ``left_date - right_date`` in ``[lo_days, hi_days]``.

    Right rows are reduced to distinct (date, key), expanded to the
    ``hi - lo + 1`` left dates they can satisfy and made distinct again, turning the band condition
    into an equi-join on (date, key). The expansion factor is the band width
    (a request parameter), not the data; the distinct is combined map-side,
    so duplicates never cross the shuffle.
    """
    keys = band_keys(right, right_date, key, left_date, lo_days, hi_days).drop("_hit")
    return left.join(keys, [left_date, key], how)
