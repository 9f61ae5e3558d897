"""A stream resumes from its checkpoint and drops rows later than the watermark."""

import datetime as dt

from pyspark.sql import functions as F

from tillscope.session import scratch_path
from tillscope.streaming.live_stream import live_visitors_stream
from tillscope.streaming.runtime import compact, read_latest, run_versioned

SCHEMA = (
    "event_id bigint, ts timestamp_ntz, event string, person_id bigint, email string, session_id string, "
    "host string, pathname string, current_url string"
)


def _rows(spark, rows):
    return spark.createDataFrame(
        [(i, t, "cart_added", p, f"u{p}@x", "s", "shop.example.com", "/", "https://shop.example.com/") for i, t, p in rows],
        SCHEMA,
    )


def test_restart_and_watermark(spark):
    src = scratch_path(spark, "restart-src")
    base = scratch_path(spark, "restart-out")
    t0 = dt.datetime(2024, 1, 10, 10, 0, 30)
    _rows(spark, [(1, t0, 1), (2, t0 + dt.timedelta(minutes=30), 2)]).write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        df = live_visitors_stream(stream, watermark="10 minutes")
        return run_versioned(df, "restart", base=base), df.schema

    run()
    # second delivery: one on-time event for person 2, one 25 minutes late for person 3
    _rows(spark, [(3, t0 + dt.timedelta(minutes=31), 2), (4, t0 + dt.timedelta(minutes=5), 3)]).write.mode(
        "append"
    ).parquet(src)
    path, shape = run()
    keys = ["window_start", "window_end", "person_id", "email"]
    out = read_latest(spark, path, keys, shape)
    persons = {r.person_id for r in out.select("person_id").distinct().collect()}
    assert persons == {1, 2}  # the late event (person 3) was dropped by the watermark
    # person 2's windows were updated across the restart: last_seen is the newer event where it falls
    last = out.where((F.col("person_id") == 2)).agg(F.max("last_seen")).first()[0]
    assert last == t0 + dt.timedelta(minutes=31)
    raw = spark.read.parquet(path)
    assert raw.select("_batch_id").distinct().count() >= 2  # two runs, state carried over
    # compaction: the same rows from one folder, and later batches on top of it
    before = sorted(map(tuple, out.collect()))
    assert compact(spark, path, keys, shape)
    after = read_latest(spark, path, keys, shape)
    assert sorted(map(tuple, after.collect())) == before
    assert len(after.inputFiles()) < len(out.inputFiles()) or len(out.inputFiles()) == 1
    _rows(spark, [(5, t0 + dt.timedelta(minutes=32), 2)]).write.mode("append").parquet(src)
    run()
    last = read_latest(spark, path, keys, shape).where("person_id = 2").agg(F.max("last_seen")).first()[0]
    assert last == t0 + dt.timedelta(minutes=32)


def test_hourly_stream_fall_back_day(spark):
    """2024-04-07 (Sydney) repeats 02:00-03:00: both UTC hours count toward local hour 2."""
    from decimal import Decimal

    from tillscope.streaming.sales_stream import hourly_from_windows, hourly_sales_stream

    src = scratch_path(spark, "dst-src")
    schema = (
        "number string, email string, payment_status string, status string, total decimal(18,2), "
        "currency string, created timestamp_ntz"
    )
    rows = [
        ("1", "a@x", "FULLY_CHARGED", "FULFILLED", Decimal("10.00"), "AUD", dt.datetime(2024, 4, 6, 15, 30)),  # 02:30 AEDT
        ("2", "b@x", "FULLY_CHARGED", "FULFILLED", Decimal("5.00"), "AUD", dt.datetime(2024, 4, 6, 16, 30)),  # 02:30 AEST
        ("3", "c@x", "FULLY_CHARGED", "FULFILLED", Decimal("1.00"), "AUD", dt.datetime(2024, 4, 6, 17, 10)),  # 03:10 AEST
    ]
    spark.createDataFrame(rows, schema).write.parquet(src)
    s = hourly_sales_stream(spark.readStream.schema(schema).parquet(src))
    path = run_versioned(s, "dst")
    out = {(r.local_date.isoformat(), r.hour): (r.gross, r.orders) for r in hourly_from_windows(read_latest(spark, path, ["window_start", "currency"], s.schema)).collect()}
    assert out == {("2024-04-07", 2): (Decimal("15.00"), 2), ("2024-04-07", 3): (Decimal("1.00"), 1)}


def test_processing_time_trigger(spark):
    """The continuous form (the dashboard's polling interval as a trigger)."""
    from tillscope.streaming.live_stream import live_visitor_panes_stream, sliding_from_panes
    from tillscope.streaming.runtime import start_versioned

    src = scratch_path(spark, "poll-src")
    base = scratch_path(spark, "poll-out")
    t0 = dt.datetime(2024, 1, 10, 10, 0, 30)
    _rows(spark, [(1, t0, 1), (2, t0 + dt.timedelta(minutes=2), 1)]).write.parquet(src)
    panes = live_visitor_panes_stream(spark.readStream.schema(SCHEMA).parquet(src))
    q = start_versioned(panes, base, processing_time="1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    panes = read_latest(spark, f"{base}/data", ["pane_start", "person_id", "email"], panes.schema)
    windows = sliding_from_panes(panes, 5, 1)
    # events at 10:00:30 and 10:02:30 -> windows starting 09:56 .. 10:02 (7 windows)
    assert windows.count() == 7
    last = {r.window_start: r.last_seen for r in windows.collect()}
    assert last[dt.datetime(2024, 1, 10, 10, 0)] == t0 + dt.timedelta(minutes=2)
    assert last[dt.datetime(2024, 1, 10, 9, 56)] == t0
