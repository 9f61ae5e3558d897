"""Login audits: A1 login_audit, A2 login_purchase_flags, A3 login_no_orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.config import DEFAULT_CONFIG, PAID_STATUS, AuditConfig
from tillscope.functions.emails import EMAIL_KEY, email_key, is_test_account, normalize_email
from tillscope.functions.timez import local_date, to_local, where_local_days
from tillscope.operators.dedupe import latest_per


def latest_logins(
    logins: DataFrame,
    d_from=None,
    d_to=None,
    with_allowance: bool = False,
    cfg: AuditConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """Latest login per (local_date, email) with the test account removed.

    The allowance filter, when asked for, runs *before* the dedupe (so it
    returns the latest login that had allowance). The dedupe key is the raw,
    case-sensitive e-mail. Columns: local_date, email, allowance, created_at,
    login_id.
    """
    l = where_local_days(logins, "created_at", d_from, d_to, cfg.tz)
    if with_allowance:
        l = l.where(F.col("allowance") > 0)
    l = l.withColumn("local_date", local_date("created_at", cfg.tz))
    # The key is a function of the e-mail: it changes no group, but lets a
    # layout by it (sources.email_layout) group without a shuffle.
    keys = ["local_date", "email", *([EMAIL_KEY] if EMAIL_KEY in l.columns else [])]
    latest = latest_per(l, keys, ["created_at", "login_id"], ["allowance", "created_at", "login_id"])
    return latest.where(~is_test_account("email", cfg.test_account))


def order_stats(carts: DataFrame) -> DataFrame:
    """All-time converted-cart count and last converted time per e-mail key."""
    return (
        carts.where(F.col("is_converted") == F.lit(True))
        .groupBy(email_key(carts).alias(EMAIL_KEY))
        .agg(F.count(F.lit(1)).alias("order_count"), F.max("created_at").alias("last_order_utc"))
    )


def latest_plans(plans: DataFrame) -> DataFrame:
    """Latest treatment-plan time per e-mail key."""
    return plans.groupBy(email_key(plans).alias(EMAIL_KEY)).agg(F.max("created_at").alias("tp_utc"))


def login_audit(
    logins: DataFrame,
    carts: DataFrame,
    plans: DataFrame,
    d_from=None,
    d_to=None,
    with_allowance: bool = False,
    cfg: AuditConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """A1: latest login per e-mail and local day with order and plan facts.

    Both lookups are pre-aggregated to one row per e-mail key, so the joins
    are 1:1 and never fan out; Catalyst/AQE choose broadcast or sort-merge by
    their measured size.
    """
    latest = latest_logins(logins, d_from, d_to, with_allowance, cfg)
    latest = latest.withColumn(EMAIL_KEY, email_key(latest))
    out = latest.join(order_stats(carts), "email_key", "left").join(latest_plans(plans), "email_key", "left")
    return out.select(
        "local_date",
        "email",
        "allowance",
        to_local("created_at", cfg.tz).alias("login_time"),
        to_local("last_order_utc", cfg.tz).alias("last_order_at"),
        F.coalesce(F.col("order_count"), F.lit(0).cast("bigint")).alias("order_count"),
        to_local("tp_utc", cfg.tz).alias("tp_date"),
    )


def login_purchase_flags(audit: DataFrame, purchases: DataFrame) -> DataFrame:
    """A2: add has_purchased / has_unpaid from the same local day's purchases.

    Purchases are reduced to one row per (local_date, e-mail key) before the
    join, so the join is 1:1.
    """
    p = purchases.where(F.col("email").isNotNull() & (F.col("email") != ""))
    paid = F.col("payment_status").eqNullSafe(F.lit(PAID_STATUS))
    flags = p.groupBy("local_date", normalize_email("email").alias("email_key")).agg(
        F.bool_or(paid).alias("_paid"), F.bool_or(~paid).alias("_pending")
    )
    a = audit.withColumn("email_key", normalize_email("email"))
    out = a.join(flags, ["local_date", "email_key"], "left")
    return out.select(
        *audit.columns,
        F.coalesce(F.col("_paid"), F.lit(False)).alias("has_purchased"),
        (F.coalesce(F.col("_pending"), F.lit(False)) & ~F.coalesce(F.col("_paid"), F.lit(False))).alias("has_unpaid"),
    )


def login_no_orders(audit_all: DataFrame) -> DataFrame:
    """A3: logins with no converted order ever and allowance > 0 (after dedupe)."""
    return audit_all.where(F.col("last_order_at").isNull() & (F.col("allowance") > 0))
