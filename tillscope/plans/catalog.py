"""Registered queries: every audit over the whole landed tables.

Each entry is ``fn(spark, sf_dir) -> DataFrame``. Date ranges are open
(all local days present), and spines are derived in-plan from the data, so
the work grows with the tables. Keys match ``tillscope.plans.oracle``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.config import DEFAULT_CONFIG as CFG
from tillscope.audits import ShopAudits
from tillscope.functions.emails import is_test_account, mask_email, normalize_email, unmask_email
from tillscope.functions.timez import date_spine, date_spine_of, local_date
from tillscope.operators import funnel as fn
from tillscope.operators import intent, intent_history, live, logins, pages, profiles, purchases, recovery, report, search_index
from tillscope.operators.dedupe import dedupe_by
from tillscope.session import scratch_path
from tillscope.sources import sinks
from tillscope.sources.email_layout import land_by_email
from tillscope.sources.fixtures import Fixtures, amended_orders_from, order_pages_from
from tillscope.sources.landing import land_events
from tillscope.sources.order_feed import flatten_order_feed, quarantine, read_order_feed, sound_pages
from tillscope.sources.orders_table import read_orders, upsert_orders
from tillscope.sources.tables import read_landed

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}

# Registered parameters (fixed request values, not data subsets).
WEEKDAY_CUTOFF_HOUR = 19
LIVE_MINUTES = 60
SEARCH_TEXT = "user1"
PAGE_ROWS = 100
DAY_FROM, DAY_TO = "2024-01-10", "2024-01-16"


def register(name: str):
    def deco(f: QueryFn) -> QueryFn:
        QUERIES[name] = f
        return f

    return deco


def _fx(spark, sf_dir) -> Fixtures:
    return Fixtures(spark, sf_dir)


def _purchases(fx: Fixtures) -> DataFrame:
    return purchases.purchases(fx.shop_orders, cfg=CFG)


def _audit(fx: Fixtures, with_allowance: bool = False) -> DataFrame:
    return logins.login_audit(fx.logins, fx.carts, fx.treatment_plans, with_allowance=with_allowance, cfg=CFG)


def _funnel(fx: Fixtures) -> DataFrame:
    return fn.login_funnel(fx.logins, fx.activity, cfg=CFG)


def _daily_intent(fx: Fixtures) -> DataFrame:
    # The spine's bounds come from the raw rows: no second pass over the dedupes.
    days = [
        d.where(~is_test_account("email", CFG.test_account)).select(local_date(ts, CFG.tz).alias("local_date"))
        for d, ts in ((fx.logins, "created_at"), (fx.shop_orders, "created"))
    ]
    return intent.daily_intent_audit(fx.logins, _purchases(fx), date_spine_of(*days), cfg=CFG)


# --- A1-A3 logins -----------------------------------------------------------
@register("login_audit")
def q_login_audit(spark, sf_dir):
    return _audit(_fx(spark, sf_dir))


@register("login_audit_allowance")
def q_login_audit_allowance(spark, sf_dir):
    return _audit(_fx(spark, sf_dir), with_allowance=True)


@register("login_purchase_flags")
def q_login_purchase_flags(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return logins.login_purchase_flags(_audit(fx), _purchases(fx))


@register("login_labels")
def q_login_labels(spark, sf_dir):
    return report.login_labels(_audit(_fx(spark, sf_dir)))


@register("login_no_orders")
def q_login_no_orders(spark, sf_dir):
    return logins.login_no_orders(_audit(_fx(spark, sf_dir)))


# --- A4-A10 purchases -------------------------------------------------------
@register("purchases")
def q_purchases(spark, sf_dir):
    return _purchases(_fx(spark, sf_dir))


@register("purchases_paid")
def q_purchases_paid(spark, sf_dir):
    return purchases.purchase_status_filter(_purchases(_fx(spark, sf_dir)), "paid")


@register("purchases_unpaid")
def q_purchases_unpaid(spark, sf_dir):
    return purchases.purchase_status_filter(_purchases(_fx(spark, sf_dir)), "unpaid")


@register("purchase_kpis")
def q_purchase_kpis(spark, sf_dir):
    p = _purchases(_fx(spark, sf_dir))
    return purchases.purchase_kpis(p, date_spine_of(p))


@register("purchase_kpi_labels")
def q_purchase_kpi_labels(spark, sf_dir):
    p = _purchases(_fx(spark, sf_dir))
    return report.kpi_labels(purchases.purchase_kpis(p, date_spine_of(p)), CFG)


@register("hourly_sales_history")
def q_hourly_sales_history(spark, sf_dir):
    p = _purchases(_fx(spark, sf_dir))
    return purchases.hourly_sales_history(p, date_spine_of(p), CFG)


@register("hourly_cumulative_sales")
def q_hourly_cumulative_sales(spark, sf_dir):
    p = _purchases(_fx(spark, sf_dir))
    return purchases.hourly_cumulative_sales(purchases.hourly_sales_history(p, date_spine_of(p), CFG))


@register("hourly_traffic")
def q_hourly_traffic(spark, sf_dir):
    p = _purchases(_fx(spark, sf_dir))
    return purchases.hourly_traffic(p, date_spine_of(p), CFG)


@register("weekday_comparison")
def q_weekday_comparison(spark, sf_dir):
    p = _purchases(_fx(spark, sf_dir))
    return purchases.weekday_comparison(p, date_spine_of(p), WEEKDAY_CUTOFF_HOUR, 5, CFG)


# --- A11-A15 funnel ---------------------------------------------------------
@register("login_funnel")
def q_login_funnel(spark, sf_dir):
    return _funnel(_fx(spark, sf_dir))


@register("funnel_stage_counts")
def q_funnel_stage_counts(spark, sf_dir):
    return fn.funnel_stage_counts(_funnel(_fx(spark, sf_dir)))


@register("funnel_stage_breakdown")
def q_funnel_stage_breakdown(spark, sf_dir):
    return fn.funnel_stage_breakdown(_funnel(_fx(spark, sf_dir)))


@register("funnel_outcome")
def q_funnel_outcome(spark, sf_dir):
    f = fn.with_funnel_outcome(_funnel(_fx(spark, sf_dir)))
    return f.select("local_date", "email", "furthest_stage", "outcome")


@register("session_stage_rollup")
def q_session_stage_rollup(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    lg = logins.latest_logins(fx.logins, cfg=CFG)
    keys = lg.select(F.col("local_date").alias("act_date"), normalize_email("email").alias("email_key"))
    return fn.session_stage_rollup(fx.activity, keys, cfg=CFG)


# --- A16 live ---------------------------------------------------------------
@register("live_visitors")
def q_live_visitors(spark, sf_dir):
    return live.live_visitors(_fx(spark, sf_dir).activity, None, LIVE_MINUTES, CFG)


@register("live_visitor_count")
def q_live_visitor_count(spark, sf_dir):
    return live.live_count(live.live_visitors(_fx(spark, sf_dir).activity, None, LIVE_MINUTES, CFG))


@register("live_visitors_sliding")
def q_live_visitors_sliding(spark, sf_dir):
    return live.live_visitors_sliding(_fx(spark, sf_dir).activity, 5, 1, CFG)


# --- A17 recovery -----------------------------------------------------------
@register("abandoned_carts")
def q_abandoned_carts(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return recovery.abandoned_carts(fx.carts, fx.logins, cfg=CFG)


@register("abandoned_carts_allowance")
def q_abandoned_carts_allowance(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return recovery.abandoned_carts(fx.carts, fx.logins, with_allowance=True, cfg=CFG)


# --- A18-A20 intent ---------------------------------------------------------
@register("daily_intent_audit")
def q_daily_intent_audit(spark, sf_dir):
    return _daily_intent(_fx(spark, sf_dir))


@register("unfulfilled_lookups")
def q_unfulfilled_lookups(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return intent.unfulfilled_lookups(logins.latest_logins(fx.logins, cfg=CFG), _purchases(fx))


@register("intent_rolling_rate")
def q_intent_rolling_rate(spark, sf_dir):
    return intent.intent_rolling_rate(_daily_intent(_fx(spark, sf_dir)))


# --- A21-A23 profiles -------------------------------------------------------
@register("customer_order_history")
def q_customer_order_history(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return profiles.customer_order_history(fx.customers, fx.shop_orders, 10)


@register("contact_profile")
def q_contact_profile(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    req = fx.logins.select(unmask_email("email").alias("email"))
    return profiles.contact_profile(req, fx.contacts, CFG)


@register("session_replays")
def q_session_replays(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    req = logins.latest_logins(fx.logins, cfg=CFG).select("local_date", "email")
    return profiles.session_replays(fx.activity, req, CFG)


# --- A24-A27 report ---------------------------------------------------------
@register("audit_search")
def q_audit_search(spark, sf_dir):
    return report.audit_search(_purchases(_fx(spark, sf_dir)), SEARCH_TEXT)


@register("audit_sort")
def q_audit_sort(spark, sf_dir):
    return report.audit_sort(_purchases(_fx(spark, sf_dir)), "purchase_time", False, "number")


@register("export_logins")
def q_export_logins(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return report.export_projection(logins.login_purchase_flags(_audit(fx), _purchases(fx)), "logins")


@register("export_purchases")
def q_export_purchases(spark, sf_dir):
    return report.export_projection(_purchases(_fx(spark, sf_dir)), "purchases")


@register("export_funnel")
def q_export_funnel(spark, sf_dir):
    return report.export_projection(_funnel(_fx(spark, sf_dir)), "funnel")


@register("export_abandoned")
def q_export_abandoned(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return report.export_projection(recovery.abandoned_carts(fx.carts, fx.logins, cfg=CFG), "abandoned")


@register("export_intent")
def q_export_intent(spark, sf_dir):
    return report.export_projection(_daily_intent(_fx(spark, sf_dir)), "intent")


@register("purchase_labels")
def q_purchase_labels(spark, sf_dir):
    return report.purchase_labels(_purchases(_fx(spark, sf_dir)))


@register("funnel_labels")
def q_funnel_labels(spark, sf_dir):
    return report.funnel_labels(_funnel(_fx(spark, sf_dir)), CFG)


@register("weekday_labels")
def q_weekday_labels(spark, sf_dir):
    p = _purchases(_fx(spark, sf_dir))
    return report.weekday_labels(purchases.weekday_comparison(p, date_spine_of(p), WEEKDAY_CUTOFF_HOUR, 5, CFG))


@register("history_labels")
def q_history_labels(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return report.history_labels(profiles.customer_order_history(fx.customers, fx.shop_orders, 10), CFG)


@register("intent_labels")
def q_intent_labels(spark, sf_dir):
    return report.intent_labels(_daily_intent(_fx(spark, sf_dir)))


# --- B7/B8: sinks (write to the shared folder, read back with the schema) ---
@register("sink_json_purchases")
def q_sink_json_purchases(spark, sf_dir):
    p = _purchases(_fx(spark, sf_dir))
    path = sinks.write_json(p, scratch_path(spark, "purchases-json"))
    return sinks.read_json(spark, path, p.schema).select(*p.columns)


@register("sink_csv_purchases")
def q_sink_csv_purchases(spark, sf_dir):
    e = report.export_projection(_purchases(_fx(spark, sf_dir)), "purchases")
    path = sinks.write_csv(e, scratch_path(spark, "purchases-csv"))
    return sinks.read_csv(spark, path, e.schema).select(*e.columns)


# --- B: sources -------------------------------------------------------------
@register("order_feed_flatten")
def q_order_feed_flatten(spark, sf_dir):
    """Flatten nested order pages, every order fetched twice (its own day, the
    next day's previous-day fetch), and resolve the copies by number."""
    o = _fx(spark, sf_dir).shop_orders
    flat = flatten_order_feed(sound_pages(order_pages_from(o, "day").unionByName(order_pages_from(o, "prev"))))
    return dedupe_by(flat, "number", ["created", "source"]).drop("source")


@register("treatment_plan_peek")
def q_treatment_plan_peek(spark, sf_dir):
    """Scan with a row cap (LIMIT 5) under a total order, as a sampling peek."""
    tp = _fx(spark, sf_dir).treatment_plans
    return tp.orderBy(F.col("created_at").desc(), F.col("email").asc()).limit(5)


# --- Day ranges and single requests ------------------------------------------
@register("login_audit_days")
def q_login_audit_days(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return logins.login_audit(fx.logins, fx.carts, fx.treatment_plans, DAY_FROM, DAY_TO, cfg=CFG)


@register("purchases_days")
def q_purchases_days(spark, sf_dir):
    return purchases.purchases(_fx(spark, sf_dir).shop_orders, DAY_FROM, DAY_TO, CFG)


@register("hourly_sales_history_days")
def q_hourly_sales_history_days(spark, sf_dir):
    p = purchases.hourly_sales_inputs(_fx(spark, sf_dir).shop_orders, DAY_FROM, DAY_TO, CFG)
    return purchases.hourly_sales_history(p, date_spine(spark, DAY_FROM, DAY_TO), CFG)


@register("login_funnel_days")
def q_login_funnel_days(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return fn.login_funnel(fx.logins, fx.activity, DAY_FROM, DAY_TO, CFG)


@register("abandoned_carts_days")
def q_abandoned_carts_days(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return recovery.abandoned_carts(fx.carts, fx.logins, DAY_FROM, DAY_TO, cfg=CFG)


@register("daily_intent_days")
def q_daily_intent_days(spark, sf_dir):
    return ShopAudits(_fx(spark, sf_dir), CFG).daily_intent_audit(DAY_FROM, DAY_TO)


@register("session_replays_day")
def q_session_replays_day(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return profiles.session_replays_for_day(fx.activity, fx.logins.select("email"), DAY_FROM, CFG)


@register("live_visitors_hosts")
def q_live_visitors_hosts(spark, sf_dir):
    hosts = ("shop.example.com", "pay.example.com")
    return live.live_visitors(_fx(spark, sf_dir).activity, None, LIVE_MINUTES, CFG, hosts)


@register("orders_masked")
def q_orders_masked(spark, sf_dir):
    return _fx(spark, sf_dir).shop_orders.select("number", mask_email("email").alias("masked"))


@register("customer_profile_numbers")
def q_customer_profile_numbers(spark, sf_dir):
    """The nested profile (A21) of every customer, its history as text."""
    fx = _fx(spark, sf_dir)
    p = profiles.customer_profile(fx.customers, fx.shop_orders, 10, fx.customers)
    numbers = F.array_join(F.transform("history", lambda x: x["number"]), ",")
    return p.select("email", "name", F.size("history").cast("bigint").alias("orders"), numbers.alias("numbers"))


@register("order_feed_folders")
def q_order_feed_folders(spark, sf_dir):
    """Pages landed in two folders (a day's own fetch, the next day's), read as
    one relation, broken pages put aside, and resolved by number."""
    o = _fx(spark, sf_dir).shop_orders
    folders = [sinks.write_json(order_pages_from(o, name), scratch_path(spark, f"pages-{name}"), partition_by=None) for name in ("day", "prev")]
    pages, _ = quarantine(read_order_feed(spark, folders), scratch_path(spark, "pages-broken"))
    return dedupe_by(flatten_order_feed(pages), "number", ["created", "source"]).drop("source")


@register("orders_table_upserts")
def q_orders_table_upserts(spark, sf_dir):
    """The order table kept current: deliveries of amended copies are upserted
    one after the other, each rewriting only the UTC days that it touches."""
    copies, path = amended_orders_from(_fx(spark, sf_dir)._t("events")), scratch_path(spark, "orders-table")
    for i in range(3):
        upsert_orders(spark, path, copies.where(F.col("copy") == i).drop("copy"), ["source"])
    return read_orders(spark, path).drop("source", "utc_date")


@register("login_funnel_landed")
def q_login_funnel_landed(spark, sf_dir):
    """The funnel over a landed copy of the event log: its properties are parsed
    once, by the landing job, for logins and activity alike."""
    landed = Fixtures(spark, sf_dir, events=land_events(spark, sf_dir, uuid.uuid4().hex[:12], scratch_path(spark, "landed")))
    return fn.login_funnel(landed.logins, landed.activity, cfg=CFG)


@register("login_audit_by_email")
def q_login_audit_by_email(spark, sf_dir):
    """The login audit over tables laid out by e-mail: its joins don't shuffle."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = land_by_email(spark, _fx(spark, sf_dir), uuid.uuid4().hex[:12], buckets)
    return logins.login_audit(t["logins"], t["carts"], t["treatment_plans"], cfg=CFG)


@register("audit_search_indexed")
def q_audit_search_indexed(spark, sf_dir):
    """The search by an index of grams, built over the whole view."""
    p = _purchases(_fx(spark, sf_dir))
    return search_index.indexed_search(p, search_index.build_index(p, scratch_path(spark, "search-index")), SEARCH_TEXT)


@register("audit_sort_page")
def q_audit_sort_page(spark, sf_dir):
    """The third page of the sorted view: a range of the clustered copy."""
    path = pages.cluster_view(_purchases(_fx(spark, sf_dir)), scratch_path(spark, "sorted-view"), "purchase_time", False, "number")
    return pages.page(spark, path, PAGE_ROWS, skip=2 * PAGE_ROWS).drop(pages.ROW_ID)


@register("intent_rates_stored")
def q_intent_rates_stored(spark, sf_dir):
    """The rolling rates from running totals stored by day."""
    path = intent_history.land_history(_daily_intent(_fx(spark, sf_dir)), scratch_path(spark, "intent-history"))
    return intent_history.rates(spark, path)


FLAGSHIP = "login_audit"
