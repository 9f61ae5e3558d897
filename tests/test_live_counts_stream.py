"""S1 counts inside the stream: append mode, restart, late rows."""

import datetime as dt

from tests.conftest import SF001
from tests.test_stream_restart import SCHEMA, _rows
from tillscope.operators import live
from tillscope.session import scratch_path
from tillscope.sources.fixtures import Fixtures
from tillscope.streaming import catalog
from tillscope.streaming.live_stream import closing_event, live_visitor_counts, live_visitor_counts_stream
from tillscope.streaming.runtime import run_versioned

T0 = dt.datetime(2024, 1, 10, 10, 0, 30)


def _plain(events, late=()):
    """{window start: visitors} of 5-minute windows every minute."""
    out = {}
    for _, t, p in events:
        for k in range(5):
            out.setdefault(t.replace(second=0) - dt.timedelta(minutes=k), set()).add(p)
    return {w: len(v) for w, v in out.items()}


def test_counts_equal_the_batch(spark):
    got = catalog.q_live_visitor_counts_stream(spark, SF001)
    want = live_visitor_counts(live.live_visitors_sliding(Fixtures(spark, SF001).activity))
    rows = lambda d: sorted(map(tuple, d.select("window_start", "window_end", "visitors").collect()))
    assert rows(got) == rows(want) and got.count() > 100


def test_each_window_is_written_once_across_restarts(spark):
    src, base = scratch_path(spark, "counts-src"), scratch_path(spark, "counts-out")

    def run():
        s = live_visitor_counts_stream(spark.readStream.schema(SCHEMA).parquet(src))
        path = run_versioned(s, "counts", base=base, output_mode="append")
        return {r.window_start: r.visitors for r in spark.read.schema(s.schema).parquet(path).collect()}, spark.read.schema(s.schema).parquet(path).count()

    m = lambda k: T0 + dt.timedelta(minutes=k)
    first = [(1, m(0), 1), (2, m(0), 2), (3, m(1), 1), (4, m(30), 3)]
    _rows(spark, first).write.mode("append").parquet(src)
    seen, n = run()
    assert seen == {w: c for w, c in _plain(first[:3]).items()} and n == len(seen)  # the window of minute 30 is open
    second = [(5, m(31), 3), (6, m(31), 4), (7, m(2), 9)]  # person 9 is late
    _rows(spark, second).write.mode("append").parquet(src)
    again, n = run()
    assert again == seen and n == len(seen)
    closing_event(_rows(spark, first + second)).write.mode("append").parquet(src)
    done, n = run()
    assert done == _plain(first + second[:2]) and n == len(done)


def test_closing_event_of_an_empty_log(spark):
    assert closing_event(_rows(spark, [])).count() == 0
