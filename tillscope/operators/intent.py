"""Daily intent audit: A19 unfulfilled lookups, A18 daily audit, A20 rates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.config import DEFAULT_CONFIG, FULFILLED_STATUS, PAID_STATUS, AuditConfig
from tillscope.functions.emails import normalize_email
from tillscope.functions.timez import date_spine
from tillscope.operators.joins import band_keys, band_semi_join
from tillscope.operators.logins import latest_logins
from tillscope.operators.purchases import purchases

LOOKBACK_DAYS = 7
#: Days of the longer pooled rate.
RATE_DAYS = 28


def _unfulfilled_orders(p: DataFrame) -> DataFrame:
    return p.where(
        ~F.col("status").eqNullSafe(F.lit(FULFILLED_STATUS)) & F.col("email").isNotNull() & (F.col("email") != "")
    ).select(F.col("local_date").alias("order_date"), normalize_email("email").alias("email_key"))


def unfulfilled_lookups(
    daily_logins: DataFrame, p: DataFrame, lookback_days: int = LOOKBACK_DAYS
) -> DataFrame:
    """Login rows whose e-mail has a not-FULFILLED order (any payment
    state, NULL status included) on a local day in [d - lookback, d].

    ``daily_logins`` needs local_date and email; ``p`` is A4 output (test
    account already removed). Equi key e-mail plus a date band, run as an
    equi semi-join on (day, e-mail key) — never a nested loop.
    """
    logins = daily_logins.withColumn("email_key", normalize_email("email"))
    orders = _unfulfilled_orders(p)
    return band_semi_join(logins, orders, "local_date", "order_date", "email_key", 0, lookback_days).drop("email_key")


def daily_intent_audit(
    logins: DataFrame,
    p: DataFrame,
    spine: DataFrame,
    d_from=None,
    d_to=None,
    cfg: AuditConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """Per local day, logins (deduped, test account removed), logins with
    allowance (> 0, counted after the dedupe), paid orders, did_not_buy,
    non-conversion %, and logins with an unfulfilled order in the last 0..7 days.

    ``p`` is A4 output covering [d_from - 7, d_to]. The per-day e-mail list of
    the reference is the A19 relation (one row per login), not an array: a
    per-day list grows with the data and would be built in one task.
    """
    lg = latest_logins(logins, d_from, d_to, False, cfg).withColumn("email_key", normalize_email("email"))
    hits = band_keys(_unfulfilled_orders(p), "order_date", "email_key", "local_date", 0, LOOKBACK_DAYS)
    # hits is unique per (day, key): the left join flags logins without fan-out,
    # and one aggregate counts logins, allowance logins and lookups together.
    login_stats = (
        lg.join(hits, ["local_date", "email_key"], "left")
        .groupBy("local_date")
        .agg(
            F.count(F.lit(1)).alias("total_logins"),
            F.count_if(F.col("allowance") > 0).alias("total_logins_with_allowance"),
            F.count_if(F.coalesce(F.col("_hit"), F.lit(False))).alias("logins_with_unfulfilled_orders"),
        )
    )
    order_stats = (
        p.where(F.col("payment_status").eqNullSafe(F.lit(PAID_STATUS)))
        .groupBy("local_date")
        .agg(F.count(F.lit(1)).alias("total_orders"))
    )
    z = F.lit(0).cast("bigint")
    j = spine.join(login_stats, "local_date", "left").join(order_stats, "local_date", "left")
    j = j.select(
        "local_date",
        F.coalesce("total_orders", z).alias("total_orders"),
        F.coalesce("total_logins", z).alias("total_logins"),
        F.coalesce("total_logins_with_allowance", z).alias("total_logins_with_allowance"),
        F.coalesce("logins_with_unfulfilled_orders", z).alias("logins_with_unfulfilled_orders"),
    )
    dnb = F.greatest(F.lit(0).cast("bigint"), F.col("total_logins_with_allowance") - F.col("total_orders"))
    j = j.withColumn("did_not_buy", dnb)
    return j.select(
        "local_date",
        "total_orders",
        "total_logins",
        "total_logins_with_allowance",
        "did_not_buy",
        _percent("did_not_buy", "total_logins_with_allowance").alias("non_conversion_percent"),
        "logins_with_unfulfilled_orders",
    )


def _percent(num: str, den: str):
    """``round((num / den) * 100)`` in doubles, in this order; 0 if den is 0."""
    return (
        F.when(F.col(den) > 0, F.round((F.col(num) / F.col(den)) * F.lit(100.0)).cast("bigint"))
        .otherwise(F.lit(0).cast("bigint"))
    )


def intent_rolling_rate(daily: DataFrame) -> DataFrame:
    """day's %, and pooled rates over the trailing 7 and 28 days
    (ratio of sums, not mean of daily %).

    Each day's counts are spread to the days whose trailing frame contains
    it, then summed: an equi-aggregate instead of a global window, so no
    single-partition step even for long histories. ``daily`` must be dense.
    """
    spread = daily.select(
        "total_logins_with_allowance",
        "did_not_buy",
        F.explode(F.sequence(F.lit(0), F.lit(27))).alias("_lag"),
        "local_date",
    ).select(
        F.date_add("local_date", F.col("_lag")).alias("local_date"),
        "_lag",
        "total_logins_with_allowance",
        "did_not_buy",
    )
    sums = spread.groupBy("local_date").agg(
        F.sum(F.when(F.col("_lag") < 7, F.col("did_not_buy"))).alias("dnb_7d"),
        F.sum(F.when(F.col("_lag") < 7, F.col("total_logins_with_allowance"))).alias("wa_7d"),
        F.sum("did_not_buy").alias("dnb_28d"),
        F.sum("total_logins_with_allowance").alias("wa_28d"),
    )
    j = daily.select("local_date", "non_conversion_percent").join(sums, "local_date", "inner")
    return j.select(
        "local_date",
        F.col("non_conversion_percent").alias("rate_day"),
        _percent("dnb_7d", "wa_7d").alias("rate_7d"),
        _percent("dnb_28d", "wa_28d").alias("rate_28d"),
    )


def intent_orders_from(d_from: dt.date) -> dt.date:
    """First day of the orders that the rates of ``d_from`` need."""
    return d_from - dt.timedelta(days=RATE_DAYS - 1 + LOOKBACK_DAYS)


def intent_with_rates(
    logins: DataFrame,
    shop_orders: DataFrame | None,
    d_from: dt.date,
    d_to: dt.date,
    cfg: AuditConfig = DEFAULT_CONFIG,
    p: DataFrame | None = None,
) -> DataFrame:
    """A18 rows of [d_from, d_to] with their 7- and 28-day pooled rates.

    The rates of d_from need the daily rows of the 27 days before it, and
    those the orders of another ``LOOKBACK_DAYS``: ``intent_orders_from``. A job
    that has these purchases already passes them as ``p``.
    """
    first = d_from - dt.timedelta(days=RATE_DAYS - 1)
    p = purchases(shop_orders, intent_orders_from(d_from), d_to, cfg) if p is None else p
    daily = daily_intent_audit(logins, p, date_spine(logins.sparkSession, first, d_to), first, d_to, cfg)
    out = daily.join(intent_rolling_rate(daily).drop("rate_day"), "local_date")
    return out.where(F.col("local_date").between(F.lit(d_from), F.lit(d_to)))
