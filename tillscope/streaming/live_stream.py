"""Live visitors as a sliding event-time window stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.config import DEFAULT_CONFIG, AuditConfig
from tillscope.functions.labels import shop_filter
from tillscope.streaming.runtime import utc_instant


def live_visitors_stream(
    activity: DataFrame,
    minutes: int = 5,
    slide_minutes: int = 1,
    watermark: str = "10 minutes",
    cfg: AuditConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """Last seen / URL / host per (sliding window, person, email).

    ``activity`` may be streaming or static. Event time is the UTC instant of
    ``ts``; rows later than the watermark are dropped (a semantic the polled
    reference did not have).
    """
    spark = activity.sparkSession
    a = activity.where(shop_filter(cfg) & F.col("email").isNotNull() & (F.col("email") != "")).withColumn(
        "_et", utc_instant("ts", spark)
    )
    a = a.withWatermark("_et", watermark)
    order = F.struct("ts", "event_id")
    g = a.groupBy(F.window("_et", f"{minutes} minutes", f"{slide_minutes} minutes").alias("w"), "person_id", "email").agg(
        F.max("ts").alias("last_seen"),
        F.max_by("current_url", order).alias("current_url"),
        F.max_by("host", order).alias("host"),
    )
    session_tz = spark.conf.get("spark.sql.session.timeZone")
    to_utc = lambda c: F.convert_timezone(F.lit(session_tz), F.lit("UTC"), c.cast("timestamp_ntz"))
    return g.select(
        to_utc(F.col("w.start")).alias("window_start"),
        to_utc(F.col("w.end")).alias("window_end"),
        "person_id",
        "email",
        "last_seen",
        "current_url",
        "host",
    )


def live_visitor_panes_stream(
    activity: DataFrame,
    pane_minutes: int = 1,
    watermark: str = "10 minutes",
    cfg: AuditConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """Per (tumbling pane, person, email): the latest event as
    ``max(struct(ts, event_id, current_url, host))``.

    Sliding windows overlap, so a direct sliding aggregate keeps
    ``window / slide`` state rows per event; panes keep one. The sliding
    result is assembled from panes by ``sliding_from_panes`` (``max`` over
    structs is associative, so this is exact).
    """
    spark = activity.sparkSession
    a = activity.where(shop_filter(cfg) & F.col("email").isNotNull() & (F.col("email") != "")).withColumn(
        "_et", utc_instant("ts", spark)
    )
    g = (
        a.withWatermark("_et", watermark)
        .groupBy(F.window("_et", f"{pane_minutes} minutes").alias("w"), "person_id", "email")
        .agg(F.max(F.struct("ts", "event_id", "current_url", "host")).alias("last"))
    )
    session_tz = spark.conf.get("spark.sql.session.timeZone")
    return g.select(
        F.convert_timezone(F.lit(session_tz), F.lit("UTC"), F.col("w.start").cast("timestamp_ntz")).alias("pane_start"),
        "person_id",
        "email",
        F.col("last.ts").alias("last_seen"),
        F.col("last.event_id").alias("last_event_id"),
        F.col("last.current_url").alias("current_url"),
        F.col("last.host").alias("host"),
    )


def sliding_from_panes(panes: DataFrame, minutes: int = 5, pane_minutes: int = 1) -> DataFrame:
    """Sliding windows (length ``minutes``, slide = pane length) from panes:
    each pane feeds the ``minutes / pane_minutes`` windows that contain it."""
    if minutes % pane_minutes:
        raise ValueError("window length must be a multiple of the pane length")
    k = minutes // pane_minutes
    spread = panes.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_k")
    ).withColumn("window_start", F.col("pane_start") - F.make_dt_interval(mins=F.col("_k") * pane_minutes))
    g = spread.groupBy("window_start", "person_id", "email").agg(
        F.max(F.struct("last_seen", "last_event_id", "current_url", "host")).alias("last")
    )
    return g.select(
        "window_start",
        (F.col("window_start") + F.expr(f"INTERVAL {minutes} MINUTES")).alias("window_end"),
        "person_id",
        "email",
        F.col("last.last_seen").alias("last_seen"),
        F.col("last.current_url").alias("current_url"),
        F.col("last.host").alias("host"),
    )


def live_visitor_counts(visitors: DataFrame) -> DataFrame:
    """Visitors ((person, email) pairs) per window."""
    return visitors.groupBy("window_start", "window_end").agg(F.count(F.lit(1)).alias("visitors"))


def live_visitor_counts_stream(
    activity: DataFrame,
    minutes: int = 5,
    slide_minutes: int = 1,
    watermark: str = "10 minutes",
    cfg: AuditConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """Visitors per sliding window, counted in the stream: one stateful operator
    keeps each (window, person, email) once, a second counts them by window.
    To be run in append mode: a window's count is written once, when the
    watermark has passed it. Any event moves the watermark, shop page or not, so
    an idle shop's windows close too."""
    spark = activity.sparkSession
    a = activity.withColumn("_et", utc_instant("ts", spark)).withWatermark("_et", watermark)
    # One condition on the event time as well: the optimiser would else move it
    # below the watermark, which then sees shop pages only.
    seen = shop_filter(cfg) & F.col("email").isNotNull() & (F.col("email") != "")
    a = a.where(F.when(F.col("_et").isNotNull(), seen))
    once = a.groupBy(F.window("_et", f"{minutes} minutes", f"{slide_minutes} minutes").alias("w"), "person_id", "email").agg(
        F.count(F.lit(1)).alias("events")
    )
    g = once.groupBy("w").agg(F.count(F.lit(1)).alias("visitors"))
    session_tz = spark.conf.get("spark.sql.session.timeZone")
    to_utc = lambda c: F.convert_timezone(F.lit(session_tz), F.lit("UTC"), c.cast("timestamp_ntz"))
    return g.select(to_utc(F.col("w.start")).alias("window_start"), to_utc(F.col("w.end")).alias("window_end"), "visitors")


def closing_event(activity: DataFrame) -> DataFrame:
    """One event without a visitor, two days after the last of ``activity``: ends
    a finished log, so that the watermark passes all of its windows."""
    last = activity.agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts")).where("ts is not null")
    return last.select(*(F.col("ts") if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in activity.dtypes))
