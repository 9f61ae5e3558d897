"""A16 live visitors (batch form; streaming form in tillscope.streaming)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.config import DEFAULT_CONFIG, AuditConfig
from tillscope.functions.labels import shop_filter
from tillscope.functions.timez import UTC_DATE, ntz_literal


def _inside(activity: DataFrame, as_of: dt.datetime | None, minutes: int) -> Column:
    """``ts`` in [as_of - minutes, as_of]. For the newest event the upper bound
    holds anyway; one scalar subquery then stays pushable (two of one
    aggregate would be merged into a struct, which no scan takes)."""
    if as_of is not None:
        lower, upper = ntz_literal(as_of - dt.timedelta(minutes=minutes)), ntz_literal(as_of)
    else:
        lower = activity.select((F.max("ts") - F.expr(f"INTERVAL {minutes} MINUTES")).alias("lower")).scalar()
        upper = None
    cond = F.col("ts") >= lower
    if UTC_DATE in activity.columns:
        cond = cond & (F.col(UTC_DATE) >= F.to_date(lower))
    if upper is None:
        return cond
    cond = cond & (F.col("ts") <= upper)
    return cond & (F.col(UTC_DATE) <= F.to_date(upper)) if UTC_DATE in activity.columns else cond


def live_visitors(
    activity: DataFrame,
    as_of: dt.datetime | None,
    minutes: int = 5,
    cfg: AuditConfig = DEFAULT_CONFIG,
    hosts_override: tuple[str, ...] | None = None,
) -> DataFrame:
    """(person, email) pairs seen on shop surfaces in [as_of - minutes, as_of].

    ``as_of`` is a UTC instant of the request, never the wall clock; None
    means the log's newest event. The bounds reach the scan as literals or as a
    scalar subquery, and as bounds on ``utc_date`` where the log is partitioned
    by it.
    Last URL/host are ``max_by`` on (ts, event_id) so ties are deterministic.
    The test account is not removed here (as in the reference).
    """
    a = activity.where(
        _inside(activity, as_of, int(minutes))
        & shop_filter(cfg, hosts_override=hosts_override)
        & F.col("email").isNotNull()
        & (F.col("email") != "")
    )
    order = F.struct("ts", "event_id")
    return a.groupBy("person_id", "email").agg(
        F.max("ts").alias("last_seen"),
        F.max_by("current_url", order).alias("current_url"),
        F.max_by("host", order).alias("host"),
    )


def live_count(visitors: DataFrame) -> DataFrame:
    """Count of (person, email) pairs (not distinct e-mails)."""
    return visitors.agg(F.count(F.lit(1)).alias("count"))


def live_visitors_sliding(
    activity: DataFrame,
    minutes: int = 5,
    slide_minutes: int = 1,
    cfg: AuditConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """Batch twin of the streaming S1: last seen per (window, person, email)
    over sliding event-time windows of the whole activity log."""
    a = activity.where(
        shop_filter(cfg) & F.col("email").isNotNull() & (F.col("email") != "")
    ).withColumn("_ts", F.col("ts").cast("timestamp"))
    w = F.window("_ts", f"{minutes} minutes", f"{slide_minutes} minutes")
    order = F.struct("ts", "event_id")
    g = a.groupBy(w.alias("w"), "person_id", "email").agg(
        F.max("ts").alias("last_seen"),
        F.max_by("current_url", order).alias("current_url"),
        F.max_by("host", order).alias("host"),
    )
    return g.select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"),
        "person_id",
        "email",
        "last_seen",
        "current_url",
        "host",
    )
