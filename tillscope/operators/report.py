"""Report helpers: A24 search, A25 sort, A26 export projections, A27 labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.config import DEFAULT_CONFIG, PAID_STATUS, AuditConfig
from tillscope.functions.labels import (
    display_time,
    funnel_outcome,
    high_non_conversion,
    money_text,
    paid_label,
    stage_label,
    status_text,
)
from tillscope.functions.timez import to_local


def audit_search(df: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring on e-mail, or substring on order number.

    Views without an e-mail column (the intent audit) are returned unchanged
    only if the text is empty; otherwise searching them is an error.
    """
    if not text:
        return df
    if "email" not in df.columns:
        raise ValueError("search needs an 'email' column")
    q = text.lower()
    cond = F.lower(F.col("email")).contains(q)
    if "number" in df.columns:
        cond = cond | F.col("number").cast("string").contains(q)
    return df.where(F.coalesce(cond, F.lit(False)))


# Default sort key per view when none is given.
DEFAULT_SORT = {
    "logins": "login_time",
    "purchases": "purchase_time",
    "funnel": "last_activity",
    "abandoned": "cart_created",
    "intent": "local_date",
}


def newest_first(df: DataFrame, view: str) -> DataFrame:
    """A view in its default order: its time column, newest first, then a tie key."""
    tie = next((c for c in ("number", "email") if c in df.columns), None)
    return audit_sort(df, DEFAULT_SORT[view], False, tie)


def audit_sort(df: DataFrame, key: str, ascending: bool = False, tie_key: str | None = None) -> DataFrame:
    """Order by one key with NULLS LAST either way, then a tie key."""
    c = F.col(key)
    order = [c.asc_nulls_last() if ascending else c.desc_nulls_last()]
    if tie_key and tie_key != key:
        order.append(F.col(tie_key).asc_nulls_last())
    return df.orderBy(*order)


def _yes_no(c: str):
    return F.when(F.col(c), F.lit("YES")).otherwise(F.lit("NO"))


def _day_or_na(c: str):
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("N/A"))


def _dt(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def export_projection(df: DataFrame, view: str, cfg: AuditConfig = DEFAULT_CONFIG) -> DataFrame:
    """The five CSV report layouts. The headers are fixed values; all
    times are local (``cfg.tz``).

    ``local_date`` is kept as the partition column of the written report.
    """
    if view == "logins":
        cols = [
            F.col("email").alias("Email"),
            F.col("allowance").alias("Allowance Remaining"),
            F.coalesce("order_count", F.lit(0)).alias("# of Orders"),
            _day_or_na("last_order_at").alias("Last Order"),
            _day_or_na("tp_date").alias("TP Date"),
            _dt("login_time").alias("Login Time"),
            _yes_no("has_purchased").alias("Purchased Today"),
        ]
    elif view == "funnel":
        cols = [
            F.col("email").alias("Email"),
            F.coalesce("furthest_stage", F.lit("none")).alias("Furthest Stage"),
            _yes_no("cart_added").alias("Cart Added"),
            _yes_no("checkout_initiated").alias("Checkout"),
            _yes_no("payment_initiated").alias("Payment Init"),
            funnel_outcome().alias("Outcome"),
            F.coalesce("error_count", F.lit(0)).alias("Error Count"),
            F.coalesce("replay_url", F.lit("")).alias("Replay URL"),
            F.coalesce(_dt(to_local("last_activity", cfg.tz)), F.lit("")).alias("Last Activity"),
        ]
    elif view == "abandoned":
        cols = [
            F.col("email").alias("Email"),
            F.col("days_allowance_remaining").alias("Allowance Remaining"),
            _dt("cart_created_local").alias("Cart Created (Sydney)"),
        ]
    elif view == "intent":
        cols = [
            F.date_format("local_date", "yyyy-MM-dd").alias("Date"),
            F.col("total_logins").alias("Total Logins"),
            F.col("total_logins_with_allowance").alias("Logins With Allowance"),
            F.col("total_orders").alias("Total Orders"),
            F.col("did_not_buy").alias("Did Not Buy"),
            F.col("non_conversion_percent").alias("Non-Conversion %"),
            F.col("logins_with_unfulfilled_orders").alias("Unfulfilled Lookups"),
        ]
    elif view == "purchases":
        cols = [
            F.col("number").alias("Order Number"),
            F.col("email").alias("Email"),
            F.col("total").alias("Total"),
            F.col("currency").alias("Currency"),
            F.col("status").alias("Status"),
            _dt(to_local("purchase_time", cfg.tz)).alias("Purchase Time"),
        ]
    else:
        raise ValueError(f"unknown view {view!r}")
    return df.select("local_date", *cols)


def purchase_labels(p: DataFrame, cfg: AuditConfig = DEFAULT_CONFIG) -> DataFrame:
    """Display labels for purchases: PAID/UNPAID, status text, money
    text and the local display time."""
    return p.select(
        "*",
        paid_label().alias("paid_label"),
        status_text().alias("status_text"),
        money_text("total").alias("total_text"),
        display_time("purchase_time", cfg.tz).alias("time_text"),
    )


def login_labels(audit: DataFrame) -> DataFrame:
    """Login-table cells. ``last_order_at``/``tp_date`` are local
    wall times already, so they are formatted once (no zone shift)."""
    return audit.select(
        "local_date",
        "email",
        F.coalesce(F.col("order_count"), F.lit(0)).alias("orders_text"),
        F.coalesce(F.date_format("last_order_at", "dd MMM yyyy"), F.lit("No Orders")).alias("last_order_text"),
        F.coalesce(F.date_format("tp_date", "dd MMM yyyy"), F.lit("No TP Found")).alias("tp_text"),
        F.date_format("login_time", "dd MMM, HH:mm:ss").alias("login_time_text"),
    )


def kpi_labels(kpis: DataFrame, cfg: AuditConfig = DEFAULT_CONFIG) -> DataFrame:
    """A6/A27 cards: trend arrows (up when today >= yesterday), absolute
    deltas and money text; the AOV trend is NULL when yesterday had no orders.

    Money text is only formatted from exact 2-decimal amounts (the AOV is
    left numeric): formatting an arbitrary double to 2 places rounds ties
    differently across engines."""
    cur = F.col("currency")
    return kpis.select(
        "local_date",
        F.when(F.col("total_paid") >= F.col("prev_total_paid"), "up").otherwise("down").alias("total_trend"),
        F.abs("total_delta").alias("total_delta_abs"),
        F.when(F.col("prev_aov").isNull(), F.lit(None).cast("string"))
        .when(F.col("aov") >= F.col("prev_aov"), "up")
        .otherwise("down")
        .alias("aov_trend"),
        F.abs("aov_delta").alias("aov_delta_abs"),
        F.format_string("%s $%.2f", cur, F.col("total_paid").cast("double")).alias("total_paid_text"),
    )


def funnel_labels(funnel: DataFrame, cfg: AuditConfig = DEFAULT_CONFIG) -> DataFrame:
    """Stage label, outcome and display times of funnel rows."""
    return funnel.select(
        "local_date",
        "email",
        stage_label().alias("stage_label"),
        funnel_outcome().alias("outcome"),
        display_time("login_time", cfg.tz).alias("login_time_text"),
        display_time("last_activity", cfg.tz).alias("last_activity_text"),
    )


def weekday_labels(rows: DataFrame) -> DataFrame:
    """Weekday-comparison cells: ``CUR $0.00`` and ``N order(s)``, or an
    em dash when the day has no paid order."""
    has = F.col("order_count") > 0
    orders = F.concat(
        F.col("order_count").cast("string"),
        F.lit(" order"),
        F.when(F.col("order_count") != 1, F.lit("s")).otherwise(F.lit("")),
    )
    return rows.select(
        "ref_date",
        "local_date",
        "day_label",
        F.when(has, money_text("gross_sales")).otherwise(F.lit("—")).alias("gross_text"),
        F.when(has, orders).otherwise(F.lit("—")).alias("orders_text"),
    )


def history_labels(history: DataFrame, cfg: AuditConfig = DEFAULT_CONFIG) -> DataFrame:
    """Customer order history cells (``#number``, time, money, Paid/Unpaid, status)."""
    return history.select(
        "email",
        "order_rank",
        F.concat(F.lit("#"), F.col("number")).alias("number_text"),
        display_time("date", cfg.tz).alias("date_text"),
        F.format_string("%s %.2f", F.col("currency"), F.col("total").cast("double")).alias("total_text"),
        F.when(F.col("payment_status").eqNullSafe(F.lit(PAID_STATUS)), "Paid").otherwise("Unpaid").alias("paid_text"),
        status_text().alias("status_text"),
    ).where(F.col("order_rank").isNotNull())


def intent_labels(daily: DataFrame) -> DataFrame:
    """High non-conversion flag (> 70 %)."""
    return daily.withColumn("high_non_conversion", high_non_conversion())


__all__ = [
    "PAID_STATUS",
    "audit_search",
    "audit_sort",
    "export_projection",
    "funnel_labels",
    "kpi_labels",
    "login_labels",
    "history_labels",
    "intent_labels",
    "purchase_labels",
    "weekday_labels",
]
