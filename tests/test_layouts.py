"""Layouts that spare work: by e-mail, by gram, by order, by running total."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001, SF01
from tests.test_plans import plan_text
from tillscope.functions.timez import date_spine_of
from tillscope.operators import intent, intent_history, logins, pages, purchases, report, search_index
from tillscope.session import scratch_path
from tillscope.sources import email_layout
from tillscope.sources.fixtures import Fixtures


def _rows(df, columns=None):
    return Counter(tuple(r) for r in df.select(*(columns or sorted(df.columns))).collect())


# --- by e-mail ----------------------------------------------------------------
def test_login_audit_by_email_does_not_shuffle(spark):
    fx = Fixtures(spark, SF001)
    root = scratch_path(spark, "by-email")
    t = email_layout.land_by_email(spark, fx, "v1", 4, root)
    plain = logins.login_audit(fx.logins, fx.carts, fx.treatment_plans)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        by = logins.login_audit(t["logins"], t["carts"], t["treatment_plans"])
        text = plan_text(by)
        assert "Exchange" not in text and text.count("SortMergeJoin") and "SelectedBucketsCount: 4 out of 4" in text
        assert "Exchange" in plan_text(plain)
        assert _rows(by) == _rows(plain)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    for name in email_layout._names("v1").values():
        spark.sql(f"DROP TABLE {name}")
    again = email_layout.open_by_email(spark, "v1", 4, root)
    assert _rows(logins.login_audit(again["logins"], again["carts"], again["treatment_plans"])) == _rows(plain)


def test_skewed_emails_are_refused(spark, monkeypatch):
    monkeypatch.setattr(email_layout, "LEAST_ROWS", 10)
    one = spark.range(500).select(
        F.lit("hot@x").alias("email"), F.col("id").alias("login_id"), F.lit(1).alias("allowance"), F.current_timestamp().alias("created_at")
    )

    class Inputs:
        logins = carts = treatment_plans = one

    with pytest.raises(email_layout.SkewedEmails, match="500 rows"):
        email_layout.land_by_email(spark, Inputs, "hot", 16, scratch_path(spark, "hot"))


# --- by gram ------------------------------------------------------------------
def _view(spark, n=300):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abAB1.@_%ä") for _ in range(r.randrange(0, 9)))
    rows = [(None if r.random() < 0.1 else word(), None if r.random() < 0.1 else str(r.randrange(3000)), i) for i in range(n)]
    return spark.createDataFrame(rows, "email string, number string, i int")


def test_indexed_search_equals_audit_search(spark):
    view = _view(spark)
    path = search_index.build_index(view, scratch_path(spark, "index"))
    r = random.Random(9)
    emails = [x.email for x in view.where("length(email) > 4").collect()]
    texts = ["", "a", "B", "12", "ab", "%", "_", "zzzz", "299", "ä", "Ä"]
    for _ in range(14):
        e = r.choice(emails)
        a = r.randrange(len(e) - 2)
        texts.append(e[a : a + r.randrange(2, 6)])
    for text in texts:
        assert _rows(search_index.indexed_search(view, path, text)) == _rows(report.audit_search(view, text)), text
    only = view.drop("number")
    assert _rows(search_index.indexed_search(only, path, "ab")) == _rows(report.audit_search(only, "ab"))


def test_search_reads_the_rarest_grams_only(spark):
    view = _view(spark)
    path = search_index.build_index(view, scratch_path(spark, "index-plan"))
    text = plan_text(search_index.matching(spark, path, "email", "abab1"))
    scan = [x for x in text.splitlines() if "PartitionFilters" in x]
    assert any("part" in x and "field" in x for x in scan) and "In(gram, [" in text


# --- by order -----------------------------------------------------------------
@pytest.mark.parametrize("ascending", [True, False])
def test_pages_joined_equal_audit_sort(spark, ascending):
    r = random.Random(3)
    rows = [(None if r.random() < 0.2 else r.randrange(9), None if r.random() < 0.2 else r.randrange(5), i % 7) for i in range(230)]
    view = spark.createDataFrame(rows, "k int, t int, x int").repartition(3)
    path = pages.cluster_view(view, scratch_path(spark, "pages"), "k", ascending, "t")
    want = [(x.k, x.t) for x in report.audit_sort(view, "k", ascending, "t").collect()]
    got, after = [], None
    while True:
        some = pages.page(spark, path, 32, after).collect()
        if not some:
            break
        got += some
        after = some[-1][pages.ROW_ID]
    assert [(x.k, x.t) for x in got] == want
    assert Counter((x.k, x.t, x.x) for x in got) == Counter(rows) and len({x[pages.ROW_ID] for x in got}) == 230
    assert [x[pages.ROW_ID] for x in pages.page(spark, path, 10, skip=200).collect()] == [x[pages.ROW_ID] for x in got[200:210]]
    assert pages.page(spark, path, 10, skip=500).count() == 0
    text = plan_text(pages.page(spark, path, 10, skip=100))
    assert "GreaterThanOrEqual(row_id," in text and "LessThanOrEqual(row_id," in text


def test_pages_of_an_empty_view(spark):
    view = spark.createDataFrame([], "k int, t int")
    path = pages.cluster_view(view, scratch_path(spark, "pages-empty"), "k", True, "t")
    assert pages.page(spark, path, 5).count() == 0


# --- by running total -----------------------------------------------------------
@pytest.fixture(scope="module")
def daily(spark):
    fx = Fixtures(spark, SF01)
    p = purchases.purchases(fx.shop_orders)
    df = intent.daily_intent_audit(fx.logins, p, date_spine_of(p))
    return spark.createDataFrame(df.collect(), df.schema)


def test_stored_rates_equal_rolling_rates(spark, daily):
    want = _rows(intent.intent_rolling_rate(daily))
    path = intent_history.land_history(daily, scratch_path(spark, "history"))
    assert _rows(intent_history.rates(spark, path)) == want
    some = intent_history.rates(spark, path, dt.date(2024, 1, 20), dt.date(2024, 1, 25))
    assert _rows(some) == _rows(intent.intent_rolling_rate(daily).where("local_date between date '2024-01-20' and date '2024-01-25'"))


def test_years_are_joined(spark):
    """Totals run on from year to year."""
    first = dt.date(2022, 12, 1)
    rows = [(first + dt.timedelta(days=i), i % 7, (i * 3) % 11 + 1, i % 100) for i in range(800)]
    frame = spark.createDataFrame(rows, "local_date date, did_not_buy long, total_logins_with_allowance long, non_conversion_percent long")
    path = intent_history.land_history(frame, scratch_path(spark, "history-years"))
    assert _rows(intent_history.rates(spark, path)) == _rows(intent.intent_rolling_rate(frame))


def test_a_new_day_reads_the_day_before_only(spark, daily):
    days = sorted(r.local_date for r in daily.collect())
    path = intent_history.land_history(daily.where(F.col("local_date") <= days[-4]), scratch_path(spark, "history-days"))
    for day in days[-3:]:
        read = intent_history.day_before(spark, path, day)
        assert read.count() == 1
        scan = [x for x in plan_text(read).splitlines() if "PartitionFilters" in x]
        assert scan and str(day - dt.timedelta(days=1)) in scan[0]
        intent_history.append_day(spark, path, daily, day)
        intent_history.append_day(spark, path, daily, day)  # again: replaces itself
    assert _rows(intent_history.rates(spark, path)) == _rows(intent.intent_rolling_rate(daily))
    with pytest.raises(ValueError, match="not stored"):
        intent_history.append_day(spark, path, daily, days[-1] + dt.timedelta(days=5))
