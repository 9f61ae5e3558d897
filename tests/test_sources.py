"""Landed sources: order-feed pages from several folders read as one relation."""

from pyspark.sql import functions as F

from tests.conftest import SF001
from tillscope.operators.dedupe import dedupe_by
from tillscope.session import scratch_path
from tillscope.sources.fixtures import Fixtures
from tests.feed import order_feed_pages
from tillscope.sources.order_feed import flatten_order_feed, read_order_feed, sound_pages
from tillscope.sources.sinks import write_json
from tillscope.sources.tables import read_landed


def test_multi_path_feed_roundtrip(spark):
    orders = Fixtures(spark, SF001).shop_orders.drop("utc_date")
    pages = order_feed_pages(orders, page_size=25)
    own = write_json(pages.where(F.col("page_id").startswith("day-")), scratch_path(spark, "feed-day"), None)
    prev = write_json(pages.where(F.col("page_id").startswith("prev-")), scratch_path(spark, "feed-prev"), None)
    landed = read_order_feed(spark, [own, prev])  # two landed fetches, one relation
    flat = flatten_order_feed(sound_pages(landed))
    assert flat.count() == 2 * orders.count()  # every order arrives twice
    assert landed.select(F.max(F.size("data.orders.edges"))).first()[0] <= 60  # pages stay page-sized
    deduped = dedupe_by(flat, "number", ["created", "source"]).drop("source")
    cols = sorted(orders.columns)
    assert deduped.select(cols).exceptAll(orders.select(cols)).count() == 0
    assert orders.select(cols).exceptAll(deduped.select(cols)).count() == 0


def test_read_landed_parquet_union(spark):
    o = Fixtures(spark, SF001).shop_orders.drop("utc_date")
    a = scratch_path(spark, "landed-a")
    b = scratch_path(spark, "landed-b")
    o.where(F.col("created") < "2024-01-15").write.parquet(a)
    o.where(F.col("created") >= "2024-01-15").write.parquet(b)
    both = read_landed(spark, [a, b])
    assert both.count() == o.count()
