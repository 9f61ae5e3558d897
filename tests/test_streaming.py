"""Stream forms equal their batch twins on the landed data."""

from pyspark.sql import functions as F

from tests.conftest import SF001
from tests.feed import fetch_pages
from tillscope.functions.timez import date_spine_of
from tillscope.operators import live, purchases
from tillscope.sources.fixtures import Fixtures
from tillscope.streaming import catalog


def _same(a, b):
    cols = sorted(a.columns)
    assert sorted(b.columns) == cols
    assert a.select(cols).exceptAll(b.select(cols)).count() == 0
    assert b.select(cols).exceptAll(a.select(cols)).count() == 0


def test_live_stream_equals_batch_sliding(spark):
    s = catalog.q_live_visitors_stream(spark, SF001)
    b = live.live_visitors_sliding(Fixtures(spark, SF001).activity)
    _same(s, b)


def test_hourly_stream_equals_batch_history(spark):
    s = catalog.q_hourly_sales_stream(spark, SF001)
    p = purchases.purchases(Fixtures(spark, SF001).shop_orders)
    h = purchases.hourly_sales_history(p, date_spine_of(p)).where(F.col("today") > 0)
    _same(s.select("local_date", "hour", "currency", F.col("gross").alias("today")), h.select("local_date", "hour", "currency", "today"))
    assert s.select("currency").distinct().count() > 1


def test_streams_on_folder_tables(spark):
    """S1 and S3 over a (date-partitioned) folder equal their rows over a file."""
    from tillscope.session import scratch_path
    from tillscope.sources.tables import read_table

    root = scratch_path(spark, "folder-tables")
    events = read_table(spark, SF001, "events").withColumn("day", F.to_date("ts"))
    events.repartition(3).write.partitionBy("day").parquet(f"{root}/events.parquet")
    for q in (catalog.q_live_visitor_counts_stream, catalog.q_hourly_sales_stream, catalog.q_orders_stream_dedupe):
        _same(q(spark, root), q(spark, SF001))
    empty = scratch_path(spark, "empty-tables")
    events.drop("day").limit(0).write.parquet(f"{empty}/events.parquet")
    for q in (catalog.q_live_visitors_stream, catalog.q_hourly_sales_stream, catalog.q_orders_stream_dedupe):
        assert q(spark, empty).count() == 0


def _orders(spark, rows):
    schema = "number string, email string, payment_status string, status string, total decimal(18,2), currency string, created timestamp_ntz"
    return spark.createDataFrame(rows, schema)


def test_repeated_feed_rows_count_once(spark):
    from tillscope.streaming.sales_stream import hourly_from_windows, hourly_sales_stream

    o = Fixtures(spark, SF001).shop_orders
    once = hourly_from_windows(hourly_sales_stream(o))
    _same(hourly_from_windows(hourly_sales_stream(o.unionByName(o))), once)


def test_last_copy_of_an_order_wins(spark):
    import datetime as dt
    from decimal import Decimal

    from tillscope.session import scratch_path
    from tillscope.streaming.orders_stream import latest_orders, order_feed_stream, orders_stream_latest
    from tillscope.streaming.runtime import read_versions, run_versioned

    src, base = scratch_path(spark, "feed"), scratch_path(spark, "feed-out")
    at = dt.datetime(2024, 1, 10, 3, 0)
    for status in ("NOT_CHARGED", "FULLY_CHARGED"):
        fetch_pages(_orders(spark, [("1", "a@x", status, "FULFILLED", Decimal("1.00"), "AUD", at)]), 0, "day", 100).write.mode(
            "append"
        ).json(src)
        s = orders_stream_latest(order_feed_stream(spark, src))
        path = run_versioned(s, "feed", base=base)
    rows = latest_orders(read_versions(spark, path, s.schema)).collect()
    assert [(r.number, r.payment_status) for r in rows] == [("1", "FULLY_CHARGED")]


def test_order_feed_stream_dedupes(spark):
    s = catalog.q_orders_stream_dedupe(spark, SF001)
    o = Fixtures(spark, SF001).shop_orders.drop("utc_date")
    assert s.count() == o.count() == s.select("number").distinct().count()
    _same(s, o)
