"""Plan shape of every registered batch query (no data is run)."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from tillscope.plans import QUERIES

BATCH = sorted(n for n in QUERIES if not n.startswith("sink_"))


def plan_text(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", BATCH)
def test_plan_shape(spark, name):
    text = plan_text(QUERIES[name](spark, SF001))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text, f"{name}: {bad}"
    for line in text.splitlines():
        if line.strip().startswith("Window [") or " Window [" in line:
            assert "], [], [" not in line, f"{name}: window without partition"


def test_day_range_reaches_scan(spark):
    from tillscope.operators import purchases
    from tillscope.sources.fixtures import Fixtures

    p = purchases.purchases(Fixtures(spark, SF001).shop_orders, "2024-01-10", "2024-01-12")
    text = plan_text(p)
    assert "PushedFilters" in text and "GreaterThanOrEqual(ts,2024-01-09T13:00)" in text
    assert "LessThan(ts,2024-01-12T13:00)" in text


def test_range_queries_push_their_bounds(spark):
    for name in ("login_audit_days", "purchases_days", "login_funnel_days", "abandoned_carts_days", "hourly_sales_history_days"):
        text = plan_text(QUERIES[name](spark, SF001))
        assert "GreaterThanOrEqual(ts," in text and "LessThan(ts,2024-01-16T13:00)" in text, name


@pytest.fixture(scope="module")
def landed(spark):
    from tillscope.session import scratch_path
    from tillscope.sources.fixtures import Fixtures
    from tillscope.sources.landing import land_events

    return Fixtures(spark, SF001, events=land_events(spark, SF001, "v1", scratch_path(spark, "landed")))


def test_live_view_prunes(spark, landed):
    from tillscope.operators import live

    for df in (live.live_visitors(landed.activity, None, 60), live.live_count(live.live_visitors(landed.activity, None, 60))):
        text = plan_text(df)
        assert "GreaterThanOrEqual(ts,ScalarSubquery" in text
        assert any("PartitionFilters" in x and "utc_date" in x and ">=" in x for x in text.splitlines())
    at = landed.activity.agg(F.max("ts")).first()[0]
    text = plan_text(live.live_visitors(landed.activity, at, 60))
    assert "GreaterThanOrEqual(ts,2024" in text and "LessThanOrEqual(ts,2024" in text and "PartitionFilters: [isnotnull(utc_date" in text


def test_replay_day_prunes(spark, landed):
    import datetime as dt

    from tillscope.operators import profiles

    text = plan_text(profiles.session_replays_for_day(landed.activity, landed.logins.select("email"), dt.date(2024, 1, 10)))
    assert "GreaterThanOrEqual(ts,2024-01-09T12:00)" in text
    assert ">= 2024-01-09)" in text and "<= 2024-01-11)" in text and "PartitionFilters: [isnotnull(utc_date" in text


def test_email_lookup_filters_before_ranking(spark, landed):
    from tillscope.operators import profiles

    asked = spark.createDataFrame([("user3@example.com",)], "email string")
    tree = plan_text(profiles.customer_order_history(landed.customers, landed.shop_orders, 10, asked)).split("\n\n\n")[0]
    assert tree.count("LeftSemi") == 2
    assert tree.index("WindowGroupLimit") < tree.rindex("LeftSemi")  # the semi-join lies below the ranking


def test_building_a_query_runs_nothing(spark):
    from tillscope.streaming.catalog import STREAM_QUERIES

    writes = (
        "sink_", "order_feed_folders", "orders_table_upserts", "login_audit_by_email", "login_funnel_landed", "audit_search_indexed", "audit_sort_page",
        "intent_rates_stored",
    )
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "plans only")
    try:
        for name, q in QUERIES.items():
            if not name.startswith(writes) and name not in STREAM_QUERIES:
                q(spark, SF001)
        jobs = [j for j in tracker.getJobIdsForGroup("build")]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 3 * len(QUERIES)  # schema reads of Parquet footers only
    names = {tracker.getStageInfo(s).name for j in jobs for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)}
    assert all("parquet at" in n for n in names), names
