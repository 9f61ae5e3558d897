"""Golden anchors at sf0.01 for the local day D = 2024-01-29 (Sydney)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillscope.functions.timez import date_spine
from tillscope.operators import funnel, intent, live, logins, profiles, purchases, recovery

D = dt.date(2024, 1, 29)


@pytest.fixture(scope="module")
def audit(fx01):
    return logins.login_audit(fx01.logins, fx01.carts, fx01.treatment_plans, D, D).cache()


@pytest.fixture(scope="module")
def p(fx01):
    return purchases.purchases(fx01.shop_orders, D, D).cache()


def _summary(df):
    r = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("order_count") > 0).alias("with_orders"),
        F.count_if(F.col("tp_date").isNotNull()).alias("with_plan"),
        F.sum("order_count").alias("orders"),
    ).first()
    return (r.n, r.with_orders, r.with_plan, r.orders)


def test_login_audit(audit):
    assert _summary(audit) == (71, 71, 71, 413)


def test_login_audit_allowance_before_dedupe(fx01):
    a = logins.login_audit(fx01.logins, fx01.carts, fx01.treatment_plans, D, D, with_allowance=True)
    assert _summary(a) == (45, 45, 45, 258)


def test_allowance_after_dedupe_contrast(audit):
    assert audit.where(F.col("allowance") > 0).count() == 43


def test_login_no_orders(audit):
    assert logins.login_no_orders(audit).count() == 0  # every e-mail has converted carts


def test_login_purchase_flags(audit, p):
    f = logins.login_purchase_flags(audit, p)
    r = f.agg(F.count_if("has_purchased").alias("a"), F.count_if("has_unpaid").alias("b")).first()
    assert (r.a, r.b) == (17, 16)


def test_purchases(p):
    r = p.agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("t")).first()
    assert (r.n, r.t) == (79, Decimal("3821.13"))
    paid = purchases.purchase_status_filter(p, "paid").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("t")).first()
    assert (paid.n, paid.t) == (36, Decimal("1886.35"))
    unpaid = purchases.purchase_status_filter(p, "unpaid").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("t")).first()
    assert (unpaid.n, unpaid.t) == (37, Decimal("1520.74"))


def test_purchase_kpis(spark, p):
    rows = purchases.purchase_kpis(p, date_spine(spark, D, D)).collect()  # a row a currency
    total = lambda c: sum(r[c] for r in rows)
    assert len(rows) > 1 and total("total_paid") == Decimal("1886.35") and total("paid_count") == 36
    assert total("true_unpaid_total") == Decimal("1520.74")
    assert all(r.aov == (pytest.approx(float(r.total_paid) / r.paid_count) if r.paid_count else 0) for r in rows)


def test_abandoned_carts(fx01):
    assert recovery.abandoned_carts(fx01.carts, fx01.logins, D, D).count() == 22
    assert recovery.abandoned_carts(fx01.carts, fx01.logins, D, D, with_allowance=True).count() == 13


def test_funnel_stages(fx01):
    f = funnel.login_funnel(fx01.logins, fx01.activity, D, D)
    got = {r.furthest_stage: r.records for r in funnel.funnel_stage_breakdown(f).collect()}
    assert got == {
        "cart_added": 17,
        "payment_success": 13,
        "none": 10,
        "checkout_initiated": 10,
        "payment_page_visit": 8,
        "purchase_completed": 6,
        "payment_error": 4,
        "payment_initiated": 3,
    }


def test_live_visitors(fx01):
    act = fx01.activity
    as_of = act.agg(F.max("ts")).first()[0]
    assert live.live_visitors(act, as_of, 5).count() == 1
    assert live.live_visitors(act, as_of, 60).count() == 9


def test_weekday_comparison(spark, fx01):
    p28 = purchases.hourly_sales_inputs(fx01.shop_orders, D, D)
    w = purchases.weekday_comparison(p28, date_spine(spark, D, D), 19)
    got = {r.local_date.isoformat(): (r.order_count, r.gross_sales) for r in w.collect()}
    assert got == {
        "2024-01-29": (30, Decimal("1729.46")),
        "2024-01-22": (22, Decimal("1257.84")),
        "2024-01-15": (22, Decimal("1241.89")),
        "2024-01-08": (28, Decimal("1055.80")),
        "2024-01-01": (15, Decimal("770.93")),
    }
    today = [r for r in w.collect() if r.is_today]
    assert len(today) == 1 and today[0].day_label == "Today (Monday 29 Jan)"
    assert today[0].hour_label == "00:00–19:59"


def test_hourly_sales_history(spark, fx01):
    p28 = purchases.hourly_sales_inputs(fx01.shop_orders, D, D)
    h = purchases.hourly_sales_history(p28, date_spine(spark, D, D))
    assert h.count() == 24 * h.select("currency").distinct().count()
    t = h.agg(*[F.sum(c).alias(c) for c in ("today", "yesterday", "ago7d", "ago28d")]).first()
    assert (t.today, t.yesterday, t.ago7d, t.ago28d) == (
        Decimal("1886.35"),
        Decimal("804.45"),
        Decimal("1333.90"),
        Decimal("1048.68"),
    )


def test_daily_intent(spark, fx01):
    p8 = purchases.purchases(fx01.shop_orders, D - dt.timedelta(days=7), D)
    d = intent.daily_intent_audit(fx01.logins, p8, date_spine(spark, D, D), D, D).first()
    assert (d.total_logins, d.total_logins_with_allowance, d.total_orders, d.did_not_buy) == (71, 43, 36, 7)
    assert d.non_conversion_percent == 16
    assert d.logins_with_unfulfilled_orders == 50


def test_session_replays(spark, fx01):
    req = spark.createDataFrame([(D, "user3@example.com")], "local_date date, email string")
    assert profiles.session_replays(fx01.activity, req).count() == 4


def test_login_audit_month_sf0001(spark):
    from tillscope.sources.fixtures import Fixtures

    fx = Fixtures(spark, "/root/testdata/sf0.001")
    a, b = dt.date(2024, 1, 1), dt.date(2024, 1, 31)
    assert logins.login_audit(fx.logins, fx.carts, fx.treatment_plans, a, b).count() == 150
    assert logins.login_audit(fx.logins, fx.carts, fx.treatment_plans, a, b, with_allowance=True).count() == 87
