"""Broken order pages fail loudly or are put aside with a count."""

import json

import pytest

from tests.conftest import SF001
from tests.feed import order_feed_pages
from tillscope.session import scratch_path
from tillscope.sources.fixtures import Fixtures
from tillscope.sources.order_feed import flatten_order_feed, quarantine, read_order_feed, sound_pages
from tillscope.streaming.orders_stream import broken_pages_stream, latest_orders, order_feed_stream, orders_stream_latest
from tillscope.streaming.runtime import read_versions, run_versioned


@pytest.fixture(scope="module")
def feed(spark):
    """Pages of which every second is truncated; one error answer and one order
    without a number beside them."""
    pages = [r[0] for r in order_feed_pages(Fixtures(spark, SF001).shop_orders, 25).selectExpr("to_json(struct(*))").collect()]
    pages.sort()
    cut = [p[: len(p) // 2] if i % 2 else p for i, p in enumerate(pages)]
    empty = json.dumps({"page_id": "none", "data": {"orders": {"pageInfo": {"hasNextPage": False}, "edges": []}}})
    error = json.dumps({"page_id": "error", "data": None, "errors": [{"message": "rate limit"}]})
    odd = json.dumps({"page_id": "odd", "data": {"orders": {"edges": [{"node": {"userEmail": "a@x"}}]}}})
    path = scratch_path(spark, "broken-feed")
    spark.createDataFrame([(p,) for p in [*cut, empty, error, odd]], "value string").repartition(3).write.text(path)
    return path, pages[::2], len(pages[1::2])


def _numbers(rows):
    return sorted(r.number for r in rows)


def _sound(spark, pages):
    path = scratch_path(spark, "sound-feed")
    spark.createDataFrame([(p,) for p in pages], "value string").write.text(path)
    return _numbers(flatten_order_feed(read_order_feed(spark, path)).collect())


def test_a_broken_page_fails_the_job(spark, feed):
    path, good, _ = feed
    with pytest.raises(Exception, match="broken order page"):
        flatten_order_feed(sound_pages(read_order_feed(spark, path))).collect()
    with pytest.raises(Exception, match="broken order page"):
        flatten_order_feed(sound_pages(read_order_feed(spark, path))).select("number").collect()


def test_quarantine_keeps_the_rest_and_counts(spark, feed):
    path, good, broken = feed
    aside = scratch_path(spark, "aside")
    pages, count = quarantine(read_order_feed(spark, path), aside)
    assert count == broken + 2
    assert _numbers(flatten_order_feed(pages).collect()) == _sound(spark, good)
    rows = spark.read.json(aside).collect()
    assert sorted({r.reason for r in rows}) == ["malformed", "no order edges", "order without a number"]
    assert all(r.text.startswith("{") for r in rows if r.reason == "malformed")


def test_streams_fail_or_leave_broken_pages_to_the_quarantine(spark, feed):
    path, good, broken = feed
    with pytest.raises(Exception, match="broken order page"):
        run_versioned(orders_stream_latest(order_feed_stream(spark, path)), "feed-loud")
    s = orders_stream_latest(order_feed_stream(spark, path, skip_broken=True))
    rows = latest_orders(read_versions(spark, run_versioned(s, "feed-sound"), s.schema))
    assert _numbers(rows.collect()) == sorted(set(_sound(spark, good)))
    b = broken_pages_stream(spark, path)
    aside = run_versioned(b, "feed-aside", output_mode="append")
    assert read_versions(spark, aside, b.schema).count() == broken + 2
