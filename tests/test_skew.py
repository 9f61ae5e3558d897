"""A key holding a third of all rows: results stay whole and exact, and the
plans combine it map-side before any shuffle."""

import datetime as dt
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from tillscope.functions.timez import date_spine_of
from tillscope.operators import logins, purchases
from tillscope.operators.dedupe import latest_per

N = 30_000


@pytest.fixture(scope="module")
def hot_logins(spark):
    # rows 0..N-1; every third row belongs to one hot e-mail
    df = spark.range(N).select(
        F.col("id").alias("login_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot[at]x.com"))
        .otherwise(F.concat(F.lit("u"), (F.col("id") % 997).cast("string"), F.lit("[at]x.com")))
        .alias("email"),
        (F.col("id") % 13).cast("int").alias("allowance"),
        (F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 60)).alias(
            "created_at"
        ),
    )
    return df.repartition(8).cache()


def test_latest_per_hot_key_exact(spark, hot_logins):
    got = latest_per(hot_logins, ["email"], ["created_at", "login_id"], ["login_id"])
    pdf = hot_logins.toPandas()
    want = duckdb.sql(
        "SELECT email, max(login_id) AS login_id FROM pdf GROUP BY email"  # created_at grows with id
    ).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    plan = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    tree = plan.split("\n\n\n")[0]
    # partial aggregate sits below (before) the exchange
    assert tree.index("Exchange") < tree.rindex("SortAggregate")
    assert "partial_max" in plan


def test_login_audit_hot_email(spark, hot_logins):
    carts = spark.createDataFrame([], "cart_id bigint, email string, is_converted boolean, created_at timestamp_ntz")
    plans = spark.createDataFrame([], "email string, created_at timestamp_ntz")
    a = logins.login_audit(hot_logins, carts, plans)
    days = hot_logins.select(logins.local_date("created_at", "Australia/Sydney").alias("d")).distinct().count()
    hot = a.where(F.col("email") == "hot[at]x.com")
    assert hot.count() == days  # one row per local day for the hot e-mail, none lost


def test_unpaid_with_hot_email(spark):
    rows = spark.range(N).select(
        F.col("id").cast("string").alias("number"),
        F.when(F.col("id") % 3 == 0, F.lit("hot@x")).otherwise(F.concat(F.lit("u"), (F.col("id") % 101).cast("string"))).alias("email"),
        F.when(F.col("id") % 5 == 0, F.lit("FULLY_CHARGED")).otherwise(F.lit("NOT_CHARGED")).alias("payment_status"),
        F.lit("FULFILLED").alias("status"),
        F.lit(Decimal("1.00")).cast("decimal(18,2)").alias("total"),
        F.lit("AUD").alias("currency"),
        (F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 30)).alias("created"),
    )
    p = purchases.purchases(rows)
    unpaid = purchases.purchase_status_filter(p, "unpaid")
    pdf = p.toPandas()
    want = duckdb.sql(
        """SELECT count(*) FROM pdf WHERE payment_status <> 'FULLY_CHARGED' AND NOT EXISTS (
             SELECT 1 FROM pdf q WHERE q.payment_status = 'FULLY_CHARGED'
               AND q.local_date = pdf.local_date AND q.email = pdf.email)"""
    ).fetchall()[0][0]
    assert unpaid.count() == want
    salted = purchases.purchase_status_filter(p, "unpaid", salt_buckets=16)
    assert salted.count() == want
    assert salted.exceptAll(unpaid).count() == 0 and unpaid.exceptAll(salted).count() == 0
    k = purchases.purchase_kpis(p, date_spine_of(p)).agg(F.sum("true_unpaid_total")).first()[0]
    assert k == Decimal(want)  # every unpaid order is 1.00


def test_far_off_date(spark):
    """A stray far-off date makes a long spine, not a failed audit."""
    last = dt.date(9999, 1, 1)
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (last,)], "local_date date")
    assert date_spine_of(df).count() == (last - dt.date(2024, 1, 1)).days + 1
    rows = [("1", "a@x", "FULLY_CHARGED", "FULFILLED", Decimal("2.00"), "AUD", dt.datetime(2024, 1, 1)),
            ("2", "a@x", "FULLY_CHARGED", "FULFILLED", Decimal("3.00"), "AUD", dt.datetime(9998, 12, 31))]
    p = purchases.purchases(spark.createDataFrame(rows, "number string, email string, payment_status string, status string, "
                                                  "total decimal(18,2), currency string, created timestamp_ntz"))
    k = purchases.purchase_kpis(p, date_spine_of(p))
    assert k.agg(F.sum("total_paid")).first()[0] == Decimal("5.00")
