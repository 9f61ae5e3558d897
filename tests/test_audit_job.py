"""The materialising job writes the same rows the operators return."""

import datetime as dt

from pyspark.sql import functions as F

from tests.conftest import SF001
from tillscope.functions.timez import date_spine
from tillscope.operators import intent, logins, purchases
from tillscope.plans.audit_job import run_audits
from tillscope.session import scratch_path
from tillscope.sources.fixtures import Fixtures

A, B = dt.date(2024, 1, 10), dt.date(2024, 1, 16)


def _same(a, b):
    cols = sorted(a.columns)
    assert sorted(b.columns) == cols
    assert a.select(cols).exceptAll(b.select(cols)).count() == 0
    assert b.select(cols).exceptAll(a.select(cols)).count() == 0


def test_run_audits(spark):
    fx = Fixtures(spark, SF001)
    paths = run_audits(spark, fx, A, B, scratch_path(spark, "job-test"))
    assert {"login_audit", "purchases", "daily_intent_audit", "login_funnel"} <= set(paths)
    written = spark.read.parquet(paths["daily_intent_audit"])
    p = purchases.purchases(fx.shop_orders, A - dt.timedelta(days=7), B)
    direct = intent.daily_intent_audit(fx.logins, p, date_spine(spark, A, B), A, B)
    _same(written.drop("rate_7d", "rate_28d"), direct)
    audit = spark.read.parquet(paths["login_audit"])
    direct_audit = logins.login_audit(fx.logins, fx.carts, fx.treatment_plans, A, B)
    assert audit.count() == direct_audit.count()
    assert spark.read.parquet(paths["purchases"]).where(~F.col("local_date").between(A, B)).count() == 0
    hist = spark.read.parquet(paths["hourly_sales_history"])
    assert hist.count() == 24 * hist.select("local_date", "currency").distinct().count()
    assert hist.select("local_date").distinct().count() == 7


def test_second_day_leaves_the_first(spark):
    """A run replaces the days it writes and no others; files follow days."""
    fx, root = Fixtures(spark, SF001), scratch_path(spark, "job-two-days")
    run_audits(spark, fx, A, A, root)
    paths = run_audits(spark, fx, B, B, root)
    run_audits(spark, fx, B, B, root)
    for name in ("purchases", "login_audit", "daily_intent_audit", "hourly_sales_history", "login_funnel"):
        days = {r[0] for r in spark.read.parquet(paths[name]).select("local_date").distinct().collect()}
        assert days == {A, B}, name
    both = spark.read.parquet(paths["purchases"]).drop("utc_date")
    p = purchases.purchases(fx.shop_orders).where(F.col("local_date").isin(A, B))
    _same(both, p)


def test_files_per_day_follow_bytes(spark):
    from tillscope.sources.sinks import write_parquet

    p = purchases.purchases(Fixtures(spark, SF001).shop_orders).repartition(32)
    path = write_parquet(p, scratch_path(spark, "few-files"), "local_date")
    out = spark.read.parquet(path)
    assert len(out.inputFiles()) <= 2 * out.select("local_date").distinct().count()


def test_job_rates_equal_the_range_rows(spark):
    from tillscope.audits import ShopAudits
    from tillscope.plans.catalog import QUERIES

    fx = Fixtures(spark, SF001)
    rates = {r.local_date: (r.rate_7d, r.rate_28d) for r in QUERIES["intent_rolling_rate"](spark, SF001).collect()}
    day = dt.date(2024, 1, 20)
    row = ShopAudits(fx).daily_intent_audit(day).collect()
    assert [(r.local_date, (r.rate_7d, r.rate_28d)) for r in row] == [(day, rates[day])]
    job = run_audits(spark, fx, day, day, scratch_path(spark, "job-rates"))
    written = spark.read.parquet(job["daily_intent_audit"]).first()
    assert (written.rate_7d, written.rate_28d) == rates[day]
