"""Purchase audits A4-A10 over the conformed order table.

All hourly and daily views aggregate orders to (local_date, hour) or
(local_date) first; the comparisons across days (D-1, D-7, D-28, same weekday)
are then done on those tiny aggregates by exploding each aggregate row to the
reference days it feeds, so no join ever touches order-level rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillscope.config import DEFAULT_CONFIG, PAID_STATUS, AuditConfig
from tillscope.functions.emails import is_test_account
from tillscope.functions.timez import local_date, to_local, where_local_days
from tillscope.operators.dedupe import dedupe_by

HOURS = 24
#: Parts that the orders of one (day, e-mail) are dealt to by the unpaid tab.
SALT_BUCKETS = 8


def _paid() -> Column:
    return F.col("payment_status").eqNullSafe(F.lit(PAID_STATUS))


def _shift(d, days: int):
    if d is None:
        return None
    d = dt.date.fromisoformat(d) if isinstance(d, str) else d
    return d - dt.timedelta(days=days)


def purchases(
    shop_orders: DataFrame,
    d_from=None,
    d_to=None,
    cfg: AuditConfig = DEFAULT_CONFIG,
    dedupe: bool = True,
) -> DataFrame:
    """A4: orders of the local day(s), test account removed, one row per number.

    The local-day range is applied as pushed UTC bounds. Duplicate numbers
    (the same order in two fetched pages) keep the latest ``created`` copy, or
    the greatest ``source`` if a ``source`` column is present.
    """
    o = where_local_days(shop_orders, "created", d_from, d_to, cfg.tz)
    o = o.where(~is_test_account("email", cfg.test_account))
    if dedupe:
        order = ["created"] + (["source"] if "source" in o.columns else [])
        o = dedupe_by(o, "number", order)
    return o.select(
        local_date("created", cfg.tz).alias("local_date"),
        "number",
        "email",
        "payment_status",
        "total",
        "currency",
        "status",
        F.col("created").alias("purchase_time"),
    )


def purchase_status_filter(p: DataFrame, mode: str = "all", salt_buckets: int = SALT_BUCKETS) -> DataFrame:
    """A5: all / paid / unpaid tabs.

    *unpaid* = not FULLY_CHARGED and the (raw, null-safe) e-mail has no paid
    order that local day: a null-safe anti-join against the paid key set.
    All guest orders of a day share the null e-mail, so the join is salted:
    each order gets a salt from its number, the
    (distinct) payer keys are replicated once per salt, and the join matches
    on (day, e-mail, salt) — a hot e-mail's orders spread over that many tasks,
    with the same result.
    """
    if mode == "all":
        return p
    if mode == "paid":
        return p.where(_paid())
    if mode != "unpaid":
        raise ValueError(f"unknown mode {mode!r}")
    payers = p.where(_paid()).select(F.col("local_date").alias("_d"), F.col("email").alias("_e")).distinct()
    cond = (F.col("local_date") == F.col("_d")) & F.col("email").eqNullSafe(F.col("_e"))
    unpaid = p.where(~_paid())
    n = int(salt_buckets)
    left = unpaid.withColumn("_salt", F.pmod(F.xxhash64("number"), F.lit(n)))
    right = payers.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("_s"))
    return left.join(right, cond & (F.col("_salt") == F.col("_s")), "left_anti").drop("_salt")


def _currency(cfg: AuditConfig) -> Column:
    return F.coalesce("currency", F.lit(cfg.default_currency)).alias("currency")


def _with_currencies(spine: DataFrame, seen: DataFrame, cfg: AuditConfig) -> DataFrame:
    """(local_date, currency) of every spine day: the currencies ``seen`` for
    it, or the default one."""
    return spine.join(seen.select("local_date", "currency").distinct(), "local_date", "left").select(
        "local_date", _currency(cfg)
    )


def _day_stats(p: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Per local day and currency: paid total/count, 'true unpaid' total and
    row count.

    Aggregates per (day, e-mail, currency), then per (day, currency), instead
    of an anti-join: both levels combine map-side, so a hot e-mail never lands
    whole in a task. Whether an e-mail paid that day, in any currency, is a
    window over its few currency rows.
    """
    per_email = p.groupBy("local_date", "email", _currency(cfg)).agg(
        F.sum(F.when(_paid(), F.col("total"))).alias("_paid_total"),
        F.count_if(_paid()).alias("_paid_n"),
        F.sum(F.when(~_paid(), F.col("total"))).alias("_unpaid_total"),
        F.count(F.lit(1)).alias("_n"),
    )
    any_paid = F.sum("_paid_n").over(Window.partitionBy("local_date", "email"))
    return per_email.withColumn("_any_paid", any_paid).groupBy("local_date", "currency").agg(
        F.coalesce(F.sum("_paid_total"), F.lit(0)).cast("decimal(18,2)").alias("total_paid"),
        F.sum("_paid_n").cast("bigint").alias("paid_count"),
        F.coalesce(F.sum(F.when(F.col("_any_paid") == 0, F.col("_unpaid_total"))), F.lit(0))
        .cast("decimal(18,2)")
        .alias("true_unpaid_total"),
        F.sum("_n").cast("bigint").alias("n_orders"),
    )


def purchase_kpis(p: DataFrame, spine: DataFrame, cfg: AuditConfig = DEFAULT_CONFIG) -> DataFrame:
    """Daily KPI cards with the previous-day comparison, per currency.

    ``spine`` is a dense ``local_date`` frame; days without orders get zeros
    in the default currency. Previous-day AOV is NULL when the previous day
    has no orders of the currency at all.
    """
    stats = _day_stats(p, cfg)
    before = stats.select(
        F.date_add("local_date", 1).alias("local_date"),
        "currency",
        F.col("total_paid").alias("prev_total_paid"),
        F.when(F.col("paid_count") > 0, F.col("total_paid").cast("double") / F.col("paid_count"))
        .otherwise(F.lit(0.0))
        .alias("prev_aov"),
    )
    days = ["local_date", "currency"]
    zero = F.lit(0).cast("decimal(18,2)")
    cur = _with_currencies(spine, stats.select(*days).unionByName(before.select(*days)), cfg).join(stats, days, "left").select(
        *days,
        F.coalesce("total_paid", zero).alias("total_paid"),
        F.coalesce("paid_count", F.lit(0).cast("bigint")).alias("paid_count"),
        F.coalesce("true_unpaid_total", zero).alias("true_unpaid_total"),
        F.coalesce("n_orders", F.lit(0).cast("bigint")).alias("n_orders"),
    )
    aov = F.when(F.col("paid_count") > 0, F.col("total_paid").cast("double") / F.col("paid_count")).otherwise(
        F.lit(0.0)
    )
    cur = cur.withColumn("aov", aov)
    out = cur.join(before, days, "left").withColumn("prev_total_paid", F.coalesce("prev_total_paid", zero))
    return out.select(
        *days,
        "total_paid",
        "paid_count",
        "aov",
        "true_unpaid_total",
        "n_orders",
        "prev_total_paid",
        "prev_aov",
        (F.col("total_paid") - F.col("prev_total_paid")).cast("decimal(18,2)").alias("total_delta"),
        (F.col("aov") - F.col("prev_aov")).alias("aov_delta"),
    )


def _shifted_pivot(hourly: DataFrame, value: str, series: dict[str, int], spine: DataFrame, zero, cfg=None) -> DataFrame:
    """Spread (local_date, hour, value) rows to the reference days they feed.

    Row of day d feeds reference day d + shift for every series; one pivoting
    aggregate then gives one column per series, and a left join from the
    (day x hour) spine zero-fills. With ``cfg`` all of it per currency.
    """
    by = ["currency"] if cfg else []
    contrib = F.array(
        *[F.struct(F.date_add("local_date", s).alias("ref"), F.lit(name).alias("series")) for name, s in series.items()]
    )
    spread = hourly.select("hour", *by, F.col(value).alias("_v"), F.explode(contrib).alias("_c")).select(
        F.col("_c.ref").alias("local_date"), "hour", *by, F.col("_c.series").alias("series"), "_v"
    )
    piv = spread.groupBy("local_date", "hour", *by).pivot("series", list(series)).agg(F.sum("_v"))
    days = _with_currencies(spine, spread, cfg) if cfg else spine.select("local_date")
    hours = days.select("*", F.explode(F.sequence(F.lit(0), F.lit(HOURS - 1))).alias("hour"))
    out = hours.join(piv, ["local_date", "hour", *by], "left")
    return out.select(
        "local_date",
        "hour",
        F.concat(F.col("hour").cast("string"), F.lit(":00")).alias("hour_label"),
        *by,
        *[F.coalesce(F.col(n), zero).alias(n) for n in series],
    )


def local_hour(ts: str, cfg: AuditConfig) -> Column:
    return F.hour(to_local(ts, cfg.tz))


def hourly_sales_history(p: DataFrame, spine: DataFrame, cfg: AuditConfig = DEFAULT_CONFIG) -> DataFrame:
    """FULLY_CHARGED gross per local hour for D, D-1, D-7, D-28, zero-filled.

    ``p`` must cover 28 days before the spine's first day (see
    ``hourly_sales_inputs``). Columns: local_date, hour, hour_label, currency,
    today, yesterday, ago7d, ago28d (DECIMAL(18,2)); amounts of different
    currencies are never added up.
    """
    hourly = (
        p.where(_paid())
        .groupBy("local_date", local_hour("purchase_time", cfg).alias("hour"), _currency(cfg))
        .agg(F.sum("total").cast("decimal(18,2)").alias("gross"))
    )
    series = {"today": 0, "yesterday": 1, "ago7d": 7, "ago28d": 28}
    out = _shifted_pivot(hourly, "gross", series, spine, F.lit(0).cast("decimal(18,2)"), cfg)
    return out.select("local_date", "hour", "hour_label", "currency", *[F.col(n).cast("decimal(18,2)").alias(n) for n in series])


def hourly_sales_inputs(shop_orders: DataFrame, d_from, d_to, cfg: AuditConfig = DEFAULT_CONFIG) -> DataFrame:
    """Purchases over [d_from - 28, d_to]: what A7 needs for its back series."""
    return purchases(shop_orders, _shift(d_from, 28), d_to, cfg)


def hourly_cumulative_sales(history: DataFrame) -> DataFrame:
    """Running total over hours of each A7 series, per reference day and
    currency: windows of 24 rows."""
    w = Window.partitionBy("local_date", "currency").orderBy("hour").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    series = ["today", "yesterday", "ago7d", "ago28d"]
    return history.select(
        "local_date", "hour", "hour_label", "currency", *[F.sum(n).over(w).cast("decimal(18,2)").alias(n) for n in series]
    )


def hourly_traffic(p: DataFrame, spine: DataFrame, cfg: AuditConfig = DEFAULT_CONFIG) -> DataFrame:
    """Order count per local hour (any payment status), D vs D-1, zero-filled."""
    hourly = p.groupBy("local_date", local_hour("purchase_time", cfg).alias("hour")).agg(
        F.count(F.lit(1)).alias("n")
    )
    out = _shifted_pivot(hourly, "n", {"today": 0, "yesterday": 1}, spine, F.lit(0).cast("bigint"))
    return out.select("local_date", "hour", "hour_label", F.col("today").cast("bigint"), F.col("yesterday").cast("bigint"))


def weekday_comparison(
    p: DataFrame,
    spine: DataFrame,
    cutoff_hour: int,
    weeks: int = 5,
    cfg: AuditConfig = DEFAULT_CONFIG,
    by_currency: bool = False,
) -> DataFrame:
    """A10: for each reference day D, paid gross/count over hours 00..H on
    D, D-7, ..., D-7*(weeks-1); zero rows kept.

    Columns: ref_date, local_date, day_label, is_today, hour_label,
    gross_sales, currency, order_count. By default amounts of all currencies
    are summed and ``currency`` is the latest order's (the dashboard's single
    currency view); ``by_currency=True`` keeps one row per currency instead
    (days without orders keep one zero row in the default currency).
    """
    if not 0 <= cutoff_hour <= 23:
        raise ValueError("cutoff_hour must be in 0..23")
    cut = p.where(_paid() & (local_hour("purchase_time", cfg) <= cutoff_hour))
    if by_currency:
        daily = cut.groupBy("local_date", "currency").agg(
            F.sum("total").cast("decimal(18,2)").alias("gross_sales"), F.count(F.lit(1)).alias("order_count")
        )
    else:
        daily = cut.groupBy("local_date").agg(
            F.sum("total").cast("decimal(18,2)").alias("gross_sales"),
            F.count(F.lit(1)).alias("order_count"),
            F.max_by("currency", F.struct("purchase_time", "number")).alias("currency"),
        )
    pairs = spine.select(
        F.col("local_date").alias("ref_date"), F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))).alias("_k")
    ).select("ref_date", F.date_sub("ref_date", F.col("_k") * 7).alias("local_date"))
    out = pairs.join(daily, "local_date", "left")
    label = F.date_format("local_date", "EEEE d MMM")
    is_today = F.col("local_date") == F.col("ref_date")
    return out.select(
        "ref_date",
        "local_date",
        F.when(is_today, F.concat(F.lit("Today ("), label, F.lit(")"))).otherwise(label).alias("day_label"),
        is_today.alias("is_today"),
        F.lit(f"00:00–{cutoff_hour:02d}:59").alias("hour_label"),
        F.coalesce("gross_sales", F.lit(0).cast("decimal(18,2)")).alias("gross_sales"),
        F.coalesce("currency", F.lit(cfg.default_currency)).alias("currency"),
        F.coalesce("order_count", F.lit(0).cast("bigint")).alias("order_count"),
    )
