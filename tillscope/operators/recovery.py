"""A17 abandoned carts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.config import DEFAULT_CONFIG, AuditConfig
from tillscope.functions.emails import is_test_account
from tillscope.functions.timez import local_date, to_local, where_local_days
from tillscope.operators.dedupe import latest_per


def latest_allowance(logins: DataFrame) -> DataFrame:
    """Latest-ever allowance per ``lower(email)``; NULL login times rank first
    (the source database's DESC order), ties broken by login id."""
    keyed = logins.withColumn("email_key", F.lower("email"))
    return latest_per(keyed, ["email_key"], ["created_at", "login_id"], ["allowance"], nulls_first=True)


def abandoned_carts(
    carts: DataFrame,
    logins: DataFrame,
    d_from=None,
    d_to=None,
    with_allowance: bool = False,
    cfg: AuditConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """Latest unconverted cart per e-mail and local day, with the
    e-mail's latest-ever allowance; optional ``allowance > 0``.

    The allowance depends only on ``lower(email)``, so its filter keeps or
    drops whole (day, e-mail) groups: picking the latest cart first and
    joining the allowance afterwards is the same result, and the join then
    sees one row per (day, e-mail) — no hot e-mail reaches it.
    """
    c = where_local_days(carts, "created_at", d_from, d_to, cfg.tz).where(F.col("is_converted") == F.lit(False))
    c = c.withColumn("local_date", local_date("created_at", cfg.tz))
    best = latest_per(c, ["local_date", "email"], ["created_at", "cart_id"], ["created_at"])
    best = best.where(~is_test_account("email", cfg.test_account)).withColumn("email_key", F.lower("email"))
    j = best.join(latest_allowance(logins), "email_key", "left")
    if with_allowance:
        j = j.where(F.col("allowance") > 0)
    return j.select(
        "local_date",
        "email",
        F.col("allowance").alias("days_allowance_remaining"),
        F.col("created_at").alias("cart_created"),
        to_local("created_at", cfg.tz).alias("cart_created_local"),
    )
