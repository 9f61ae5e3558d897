"""Properties across audits."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillscope.functions.timez import date_spine_of, local_date, local_day_filter
from tillscope.operators import intent, purchases


def test_cumulative_last_hour_equals_total(fx01):
    p = purchases.purchases(fx01.shop_orders)
    h = purchases.hourly_sales_history(p, date_spine_of(p))
    c = purchases.hourly_cumulative_sales(h).where(F.col("hour") == 23)
    tot = h.groupBy("local_date", "currency").agg(*[F.sum(x).alias(x) for x in ("today", "yesterday", "ago7d", "ago28d")])
    names = ("today", "yesterday", "ago7d", "ago28d")
    j = c.join(tot.select("local_date", "currency", *[F.col(x).alias("t_" + x) for x in names]), ["local_date", "currency"])
    bad = j.where(" OR ".join(f"{x} <> t_{x}" for x in ("today", "yesterday", "ago7d", "ago28d")))
    assert j.select("local_date").distinct().count() == 31 and j.count() == c.count() > 31 and bad.count() == 0


def test_days_partition_orders(fx01):
    p = purchases.purchases(fx01.shop_orders)
    per_day = p.groupBy("local_date").count().agg(F.sum("count")).first()[0]
    assert per_day == p.count() == fx01.shop_orders.where(F.col("email") != "user7@example.com").count()
    one_day = purchases.purchases(fx01.shop_orders, "2024-01-15", "2024-01-15").count()
    assert one_day == p.where(F.col("local_date") == "2024-01-15").count()


def test_paid_unpaid_hidden_cover_all(fx01):
    p = purchases.purchases(fx01.shop_orders)
    paid = purchases.purchase_status_filter(p, "paid").count()
    unpaid = purchases.purchase_status_filter(p, "unpaid").count()
    not_paid = p.where(~F.col("payment_status").eqNullSafe("FULLY_CHARGED"))
    payers = p.where(F.col("payment_status") == "FULLY_CHARGED").select("local_date", "email").distinct()
    hidden = not_paid.join(payers, ["local_date", "email"], "left_semi").count()
    assert paid + unpaid + hidden == p.count()


def test_single_day_rate_equals_daily_percent(spark, fx01):
    from tillscope.functions.timez import date_spine
    from tillscope.operators.logins import latest_logins

    d = dt.date(2024, 1, 20)
    p = purchases.purchases(fx01.shop_orders, d - dt.timedelta(days=7), d)
    daily = intent.daily_intent_audit(fx01.logins, p, date_spine(spark, d, d), d, d)
    r = intent.intent_rolling_rate(daily).first()
    assert r.rate_day == r.rate_7d == r.rate_28d
    assert latest_logins(fx01.logins, d, d).count() == daily.first().total_logins


@settings(max_examples=60, deadline=None)
@given(
    st.datetimes(min_value=dt.datetime(2023, 12, 25), max_value=dt.datetime(2025, 1, 5)),
    st.dates(min_value=dt.date(2024, 1, 1), max_value=dt.date(2024, 12, 31)),
    st.integers(min_value=0, max_value=3),
)
def test_bounds_equal_converted_date(spark_h, t, d, span):
    tz = "Australia/Sydney"
    d2 = d + dt.timedelta(days=span)
    df = spark_h.createDataFrame([(t,)], "ts timestamp_ntz")
    a = df.where(local_day_filter("ts", d, d2, tz)).count()
    b = df.where(local_date("ts", tz).between(F.lit(d), F.lit(d2))).count()
    assert a == b


import pytest  # noqa: E402


@pytest.fixture(scope="module")
def spark_h(spark):
    return spark
