"""Profiles: A21 customer profile, A22 contact profile, A23 session replays.

The reference looks these up one e-mail at a time; here they are bulk joins
from an ``emails`` DataFrame, so a whole day's (or all) logins resolve in one job.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillscope.config import DEFAULT_CONFIG, AuditConfig
from tillscope.functions.emails import normalize_email
from tillscope.functions.timez import UTC_DATE, utc_window_filter
from tillscope.operators.dedupe import dedupe_by, latest_per

HISTORY_FIELDS = ("number", "date", "total", "currency", "payment_status", "status")


def _full_name(first: str, last: str):
    return F.nullif(F.trim(F.concat_ws(" ", F.col(first), F.col(last))), F.lit(""))


def customer_order_history(
    customers: DataFrame, shop_orders: DataFrame, n: int = 10, emails: DataFrame | None = None
) -> DataFrame:
    """A21 (flat): each customer with up to ``n`` latest orders, one row per
    order (order_rank 1 = newest; created desc, number desc). Customers with no
    orders keep one row with NULL order fields.

    An order that the feed repeats counts once (its latest copy). ``emails``
    (an ``email`` column) restricts both sides before anything is ranked.

    ``row_number() <= n`` is planned as a partial WindowGroupLimit before the
    exchange, so a hot customer ships at most ``n`` rows per map partition.
    """
    customers = customers.withColumn("email_key", normalize_email("email"))
    shop_orders = shop_orders.withColumn("email_key", normalize_email("email"))
    if emails is not None:
        asked = emails.select(normalize_email("email").alias("email_key")).distinct()
        customers = customers.join(asked, "email_key", "left_semi")
        shop_orders = shop_orders.join(asked, "email_key", "left_semi")
    shop_orders = dedupe_by(shop_orders, "number", ["created"] + (["source"] if "source" in shop_orders.columns else []))
    cust = latest_per(
        customers,
        ["email_key"],
        ["email"],
        ["email", "first_name", "last_name"],
    )
    o = shop_orders.select(
        "email_key",
        "number",
        F.col("created").alias("date"),
        "total",
        "currency",
        "payment_status",
        "status",
    )
    w = Window.partitionBy("email_key").orderBy(F.col("date").desc(), F.col("number").desc())
    top = o.withColumn("order_rank", F.row_number().over(w)).where(F.col("order_rank") <= n)
    j = cust.join(top, "email_key", "left")
    return j.select(
        "email",
        F.coalesce(_full_name("first_name", "last_name"), F.lit("Anonymous")).alias("name"),
        "order_rank",
        *HISTORY_FIELDS,
    )


def customer_profile(
    customers: DataFrame, shop_orders: DataFrame, n: int = 10, emails: DataFrame | None = None
) -> DataFrame:
    """A21 (nested): email, name, history ARRAY<STRUCT> newest first.

    The list is bounded by ``n`` per customer, so the grouping is bounded.
    """
    flat = customer_order_history(customers, shop_orders, n, emails)
    item = F.struct(F.col("order_rank"), *[F.col(c) for c in HISTORY_FIELDS])
    g = flat.groupBy("email", "name").agg(
        F.sort_array(F.collect_list(F.when(F.col("order_rank").isNotNull(), item))).alias("_h")
    )
    return g.select("email", "name", F.transform("_h", lambda x: x.dropFields("order_rank")).alias("history"))


def contact_profile(emails: DataFrame, contacts: DataFrame, cfg: AuditConfig = DEFAULT_CONFIG) -> DataFrame:
    """One row per requested e-mail with CRM fallbacks.

    name: full name, else "first last" trimmed, else 'Not Found'; phone 'N/A';
    email: the contact's, else the requested one; crm_url only when found.
    Contacts are reduced to one per normalised e-mail (lowest id) first.
    """
    req = emails.select(F.col("email").alias("requested")).distinct().withColumn(
        "email_key", normalize_email("requested")
    )
    c = contacts.withColumn("email_key", normalize_email("email"))
    # Lowest id wins: min over a struct led by the id (combined map-side).
    best = c.groupBy("email_key").agg(
        F.min(F.struct("id", "full_name", "first_name", "last_name", "email", "phone")).alias("_c")
    )
    j = req.join(best, "email_key", "left")
    found = F.col("_c.id").isNotNull()
    name = F.coalesce(
        F.nullif(F.col("_c.full_name"), F.lit("")),
        F.nullif(
            F.trim(F.concat(F.coalesce(F.col("_c.first_name"), F.lit("")), F.lit(" "), F.coalesce(F.col("_c.last_name"), F.lit("")))),
            F.lit(""),
        ),
        F.lit("Not Found"),
    )
    return j.select(
        F.col("requested"),
        F.col("_c.id").alias("id"),
        name.alias("name"),
        F.coalesce(F.nullif(F.col("_c.email"), F.lit("")), F.col("requested")).alias("email"),
        F.coalesce(F.nullif(F.col("_c.phone"), F.lit("")), F.lit("N/A")).alias("phone"),
        F.when(found, F.concat(F.lit(cfg.crm_base), F.col("_c.id"))).alias("crm_url"),
    )


def session_replays(activity: DataFrame, requests: DataFrame, cfg: AuditConfig = DEFAULT_CONFIG) -> DataFrame:
    """For each requested (local_date D, email), sessions seen in the UTC
    window [D-1 12:00, D+1 12:00) with a non-NULL session id; start_time is
    the first event inside the window.

    An event at ``ts`` lies in the windows of exactly the days
    ``to_date(ts - 12h)`` and ``to_date(ts - 12h) + 1``, so each event is
    expanded to those two candidate days and joined on (day, e-mail key):
    an equi-join instead of a range join.
    """
    req = requests.select("local_date", normalize_email("email").alias("email_key")).distinct()
    base = F.to_date(F.col("ts") - F.expr("INTERVAL 12 HOURS"))
    # First event per (e-mail, session, shifted day): combined map-side, so
    # only session-day rows are expanded, shuffled and joined.
    firsts = (
        activity.where(F.col("session_id").isNotNull() & F.col("email").isNotNull())
        .groupBy(normalize_email("email").alias("email_key"), "session_id", base.alias("_base"))
        .agg(F.min("ts").alias("_first"))
    )
    cand = firsts.select(
        "email_key", "session_id", "_first", F.explode(F.array("_base", F.date_add("_base", 1))).alias("local_date")
    ).join(req, ["local_date", "email_key"], "left_semi")
    g = cand.groupBy("local_date", "email_key", "session_id").agg(F.min("_first").alias("start_time"))
    return g.select(
        "local_date",
        F.col("email_key").alias("email"),
        "session_id",
        "start_time",
        F.concat(F.lit(cfg.replay_base), F.col("session_id")).alias("url"),
    )


def replay_window(d: dt.date) -> tuple[dt.datetime, dt.datetime]:
    """UTC window the replay lookup covers for local day ``d``."""
    start = dt.datetime(d.year, d.month, d.day, 12) - dt.timedelta(days=1)
    return start, start + dt.timedelta(days=2)


def session_replays_for_day(
    activity: DataFrame, emails: DataFrame, d: dt.date, cfg: AuditConfig = DEFAULT_CONFIG
) -> DataFrame:
    """A23 in its single-day form: the 48-hour UTC window of ``d`` as a
    pushed half-open range, then first event per (e-mail, session)."""
    start, end = replay_window(dt.date.fromisoformat(d) if isinstance(d, str) else d)
    req = emails.select(normalize_email("email").alias("email_key")).distinct()
    day = F.lit(True)
    if UTC_DATE in activity.columns:
        day = F.col(UTC_DATE).between(F.lit(start.date()), F.lit(end.date()))
    a = activity.where(
        day & utc_window_filter("ts", start, end) & F.col("session_id").isNotNull() & F.col("email").isNotNull()
    ).withColumn("email_key", normalize_email("email"))
    g = a.join(req, "email_key", "left_semi").groupBy("email_key", "session_id").agg(F.min("ts").alias("start_time"))
    return g.select(
        F.lit(start.date() + dt.timedelta(days=1)).alias("local_date"),
        F.col("email_key").alias("email"),
        "session_id",
        "start_time",
        F.concat(F.lit(cfg.replay_base), F.col("session_id")).alias("url"),
    )
