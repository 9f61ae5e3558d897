"""Registered streaming queries: each runs its stream to completion
(``availableNow``) into the shared folder and returns the final result read
back as a batch DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillscope.plans.oracle import AMENDED, ORACLE_SQL, SHOP, not_test, w
from tillscope.session import scratch_path
from tillscope.sources.fixtures import activity_from, amended_orders_from, order_pages_from, shop_orders_from
from tillscope.sources.sinks import write_json
from tillscope.sources.tables import read_table
from tillscope.streaming.live_stream import closing_event, live_visitor_counts_stream, live_visitor_panes_stream, sliding_from_panes
from tillscope.streaming.orders_stream import latest_orders, order_feed_stream, orders_stream_latest
from tillscope.streaming.runtime import read_latest, read_versions, run_versioned
from tillscope.streaming.sales_stream import (
    amended_sales_stream, hourly_from_deltas, hourly_from_windows, hourly_sales_stream, summed_deltas,
)
from tillscope.streaming.sources import table_stream

STREAM_QUERIES: dict = {}
STREAM_ORACLE_SQL: dict = {}


def _live(spark, sf_dir):
    """The stream keeps 1-minute panes; 5-minute sliding windows are
    assembled from the panes' final versions."""
    s = live_visitor_panes_stream(activity_from(table_stream(spark, sf_dir, "events")))
    path = run_versioned(s, "s1-live")
    panes = read_latest(spark, path, ["pane_start", "person_id", "email"], s.schema)
    return sliding_from_panes(panes, 5, 1)


def q_live_visitors_stream(spark, sf_dir):
    return _live(spark, sf_dir)


def q_live_visitor_counts_stream(spark, sf_dir):
    """S1 counts, each written once by the stream itself. The log is finished,
    so its activity is followed by an event that closes the last windows."""
    events = read_table(spark, sf_dir, "events")
    end = scratch_path(spark, "s1-end")
    closing_event(activity_from(events)).write.parquet(end)
    live = activity_from(table_stream(spark, sf_dir, "events"))
    s = live_visitor_counts_stream(live.unionByName(spark.readStream.schema(live.schema).parquet(end)))
    return spark.read.schema(s.schema).parquet(run_versioned(s, "s1-counts", output_mode="append")).select(*s.columns)


def q_orders_stream_dedupe(spark, sf_dir):
    o = shop_orders_from(read_table(spark, sf_dir, "events"))
    pages = order_pages_from(o, "day").unionByName(order_pages_from(o, "prev"))
    landed = write_json(pages, scratch_path(spark, "s2-pages"), partition_by=None)
    s = orders_stream_latest(order_feed_stream(spark, landed))
    return latest_orders(read_versions(spark, run_versioned(s, "s2-orders"), s.schema))


def q_hourly_sales_stream(spark, sf_dir):
    s = hourly_sales_stream(shop_orders_from(table_stream(spark, sf_dir, "events")))
    return hourly_from_windows(read_latest(spark, run_versioned(s, "s3-sales"), ["window_start", "currency"], s.schema))


def q_hourly_sales_amended_stream(spark, sf_dir):
    """S3 over amended orders: three deliveries (placed, charged, refunded or
    corrected), the stream resumed after each."""
    copies = amended_orders_from(read_table(spark, sf_dir, "events"))
    src, base = scratch_path(spark, "s3-copies"), scratch_path(spark, "s3-amended")
    for i in range(3):
        copies.where(F.col("copy") == i).drop("copy").write.mode("append").parquet(src)
        s = amended_sales_stream(spark.readStream.schema(copies.drop("copy").schema).parquet(src), overlap="60 days")
        path = run_versioned(s, "s3-amended", base=base, per_batch=summed_deltas)
    return hourly_from_deltas(read_versions(spark, path, s.schema))


STREAM_QUERIES.update(
    {
        "live_visitors_stream": q_live_visitors_stream,
        "live_visitor_counts_stream": q_live_visitor_counts_stream,
        "orders_stream_dedupe": q_orders_stream_dedupe,
        "hourly_sales_stream": q_hourly_sales_stream,
        "hourly_sales_amended_stream": q_hourly_sales_amended_stream,
    }
)

STREAM_ORACLE_SQL["live_visitors_stream"] = ORACLE_SQL["live_visitors_sliding"]
STREAM_ORACLE_SQL["live_visitor_counts_stream"] = w(
    f"""
aw AS (SELECT a.*, date_trunc('minute', ts) - k * INTERVAL 1 MINUTE AS window_start
       FROM activity a, range(5) r(k)
       WHERE {SHOP} AND email IS NOT NULL AND email <> '')""".strip()
) + """
SELECT window_start, window_start + INTERVAL 5 MINUTE AS window_end, count(DISTINCT (person_id, email)) AS visitors
FROM aw GROUP BY 1, 2"""
STREAM_ORACLE_SQL["orders_stream_dedupe"] = w() + "SELECT * FROM shop_orders"
STREAM_ORACLE_SQL["hourly_sales_stream"] = w() + f"""
SELECT CAST(timezone('Australia/Sydney', timezone('UTC', created)) AS DATE) AS local_date,
       CAST(hour(timezone('Australia/Sydney', timezone('UTC', created))) AS INTEGER) AS hour, currency,
       CAST(sum(total) AS DECIMAL(18,2)) AS gross, count(*) AS orders
FROM shop_orders
WHERE payment_status IS NOT DISTINCT FROM 'FULLY_CHARGED' AND {not_test('email')}
GROUP BY 1, 2, 3"""
STREAM_ORACLE_SQL["hourly_sales_amended_stream"] = STREAM_ORACLE_SQL["hourly_sales_stream"].replace("FROM shop_orders\n", f"FROM ({AMENDED})\n")

__all__ = ["STREAM_ORACLE_SQL", "STREAM_QUERIES"]
