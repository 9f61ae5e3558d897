"""Local calendar days over UTC instants, DST included.

Stored instants are ``TIMESTAMP_NTZ`` holding UTC wall time. Local time is
``convert_timezone('UTC', tz, ts)``, which does not depend on the session
zone. A filter on the converted value cannot reach the Parquet scan, so
``local_day_filter`` states the same range as exact UTC bounds, which Catalyst
pushes down (and which prune a ``created_date`` partition column if present).
"""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Partition column of landed tables: the UTC date of the event time.
UTC_DATE = "utc_date"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _as_date(d: dt.date | str) -> dt.date:
    return dt.date.fromisoformat(d) if isinstance(d, str) else d


def to_local(ts: Column | str, tz: str) -> Column:
    """UTC wall time (NTZ) -> local wall time (NTZ) in ``tz``."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), _col(ts))


def local_date(ts: Column | str, tz: str) -> Column:
    """Local calendar date of a UTC NTZ instant."""
    return F.to_date(to_local(ts, tz))


def ntz_literal(value: dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal that is independent of any session zone."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def utc_start_of_local_day(d: dt.date, tz: str) -> dt.datetime:
    """UTC wall time of local midnight that starts ``d`` (23/25-hour days exact)."""
    local = dt.datetime(d.year, d.month, d.day, tzinfo=ZoneInfo(tz))
    return local.astimezone(dt.timezone.utc).replace(tzinfo=None)


def local_day_filter(ts: Column | str, d_from, d_to, tz: str) -> Column:
    """``d_from <= local_date(ts) <= d_to`` as pushable UTC bounds.

    Either bound may be None (open). Returns ``lit(True)`` when both are None.
    """
    c = _col(ts)
    cond = F.lit(True)
    if d_from is not None:
        cond = cond & (c >= ntz_literal(utc_start_of_local_day(_as_date(d_from), tz)))
    if d_to is not None:
        nxt = _as_date(d_to) + dt.timedelta(days=1)
        cond = cond & (c < ntz_literal(utc_start_of_local_day(nxt, tz)))
    return cond


def where_local_days(df: DataFrame, ts: str, d_from, d_to, tz: str) -> DataFrame:
    """``df`` restricted to local days [d_from, d_to] of ``ts``.

    Adds the pushable UTC bounds and, when ``df`` carries the ``utc_date``
    partition column (the UTC date of ``ts``), the matching partition
    predicate so whole partitions are pruned.
    """
    out = df.where(local_day_filter(ts, d_from, d_to, tz))
    if UTC_DATE in df.columns and (d_from is not None or d_to is not None):
        c = F.col(UTC_DATE)
        if d_from is not None:
            out = out.where(c >= F.lit(utc_start_of_local_day(_as_date(d_from), tz).date()))
        if d_to is not None:
            end = utc_start_of_local_day(_as_date(d_to) + dt.timedelta(days=1), tz) - dt.timedelta(microseconds=1)
            out = out.where(c <= F.lit(end.date()))
    return out


def utc_window_filter(ts: Column | str, start: dt.datetime, end: dt.datetime) -> Column:
    """Half-open UTC range ``start <= ts < end``."""
    c = _col(ts)
    return (c >= ntz_literal(start)) & (c < ntz_literal(end))


def date_spine(spark: SparkSession, d_from, d_to, name: str = "local_date") -> DataFrame:
    """Dense date spine of the requested days."""
    a, b = _as_date(d_from), _as_date(d_to)
    n = (b - a).days + 1
    if n <= 0:
        raise ValueError(f"empty date range {a}..{b}")
    return spark.range(n).select(F.date_add(F.lit(a), F.col("id").cast("int")).alias(name))


def date_spine_of(*dated: DataFrame, col: str = "local_date", name: str = "local_date") -> DataFrame:
    """Dense spine from the min to the max of ``col`` over the given frames.

    Built in-plan (one tiny aggregate, then ``explode(sequence)``), so the
    spine follows the data without a driver round trip. The DATE domain bounds
    it at about 3.7 million days; the days are dealt by hash after the explode,
    so that a stray far-off date costs rows spread over tasks, not a failure.
    """
    parts = [d.select(F.col(col).alias("_d")) for d in dated]
    allc = parts[0]
    for p in parts[1:]:
        allc = allc.unionByName(p)
    bounds = allc.agg(F.min("_d").alias("_lo"), F.max("_d").alias("_hi")).where(F.col("_lo").isNotNull())
    return bounds.select(F.explode(F.sequence(F.col("_lo"), F.col("_hi"))).alias(name)).repartition(name)
