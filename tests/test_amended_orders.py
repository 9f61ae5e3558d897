"""Amended orders: retractions in the hourly stream, upserts by day."""

import datetime as dt
import itertools
import os
import random
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from tillscope.config import AuditConfig
from tillscope.functions.timez import date_spine_of
from tillscope.operators import purchases
from tillscope.session import scratch_path
from tillscope.sources.fixtures import amended_orders_from
from tillscope.sources.orders_table import read_orders, upsert_orders
from tillscope.sources.tables import read_table
from tillscope.streaming import sales_stream
from tillscope.streaming.runtime import compact, read_versions, run_versioned

SCHEMA = (
    "number string, email string, payment_status string, status string, total decimal(18,2), currency string, "
    "created timestamp_ntz, source string"
)


def _copies(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _copy(i, status, total, source, hour=3, currency="AUD", email="a@x"):
    total = None if total is None else Decimal(total)
    return (str(i), email, status, "FULFILLED", total, currency, dt.datetime(2024, 1, 10, hour, 5), f"{source:03d}")


def _stream(spark, deliveries, cfg=None, overlap="2 days", between=None):
    """Deliver one after the other, the stream resumed after each."""
    src, base = scratch_path(spark, "amended"), scratch_path(spark, "amended-out")
    for i, rows in enumerate(deliveries):
        _copies(spark, rows).write.mode("append").parquet(src)
        s = sales_stream.amended_sales_stream(spark.readStream.schema(SCHEMA).parquet(src), overlap, *([cfg] if cfg else []))
        path = run_versioned(s, "amended", base=base, per_batch=sales_stream.summed_deltas)
        if between and i == len(deliveries) // 2:
            assert compact(spark, path, [], s.schema, combine=sales_stream.summed_deltas)
    out = sales_stream.hourly_from_deltas(read_versions(spark, path, s.schema)).collect()
    return {(r.local_date.isoformat(), r.hour, r.currency): (r.gross, r.orders) for r in out}, path


def _a7(spark, deliveries):
    """A7's hourly gross on the last copies."""
    p = purchases.purchases(_copies(spark, list(itertools.chain(*deliveries))))
    h = purchases.hourly_sales_history(p, date_spine_of(p)).where("today <> 0")
    return {(r.local_date.isoformat(), r.hour, r.currency): r.today for r in h.collect()}


def test_paid_then_refunded(spark):
    steps = [
        [_copy(1, "NOT_CHARGED", "10.00", 1), _copy(2, "FULLY_CHARGED", "5.00", 1)],
        [_copy(1, "FULLY_CHARGED", "10.00", 2), _copy(2, "FULLY_CHARGED", "7.50", 2), _copy(3, "FULLY_CHARGED", "1.00", 1, currency="NZD")],
        [_copy(1, "FULLY_REFUNDED", "10.00", 3), _copy(3, "FULLY_CHARGED", "1.00", 1, currency="NZD")],
    ]
    day = "2024-01-10"
    assert _stream(spark, steps[:1])[0] == {(day, 14, "AUD"): (Decimal("5.00"), 1)}
    assert _stream(spark, steps[:2])[0] == {(day, 14, "AUD"): (Decimal("17.50"), 2), (day, 14, "NZD"): (Decimal("1.00"), 1)}
    assert _stream(spark, steps)[0] == {(day, 14, "AUD"): (Decimal("7.50"), 1), (day, 14, "NZD"): (Decimal("1.00"), 1)}


def test_random_sequences_equal_a7_on_the_last_copies(spark):
    """Copies in any order of arrival, repeated, out of order within and across
    deliveries, test account and null e-mails included; compacted halfway."""
    r = random.Random(5)
    states = ["NOT_CHARGED", "FULLY_CHARGED", "FULLY_REFUNDED", None]
    steps, rows = [], []
    for i in range(160):
        email = r.choice(["a@x", None, "user7@example.com"])
        for c in range(r.randrange(1, 5)):
            rows.append(_copy(i, r.choice(states), f"{r.randrange(1, 900) / 100:.2f}", c, hour=i % 20, currency=r.choice(["AUD", "USD"]), email=email))
    r.shuffle(rows)
    rows += rows[:20]
    steps = [rows[k::4] for k in range(4)]
    got, path = _stream(spark, steps, between=True)
    assert {k: v[0] for k, v in got.items()} == _a7(spark, steps)
    assert len(got) > 10 and {k[2] for k in got} == {"AUD", "USD"}


def test_state_ends_after_the_overlap(spark):
    """A copy that comes after its order's time is over is dropped as late."""
    late = (*_copy(1, "FULLY_REFUNDED", "10.00", 9)[:6], dt.datetime(2024, 1, 10, 3, 5), "009")
    newer = (*_copy(2, "FULLY_CHARGED", "3.00", 1)[:6], dt.datetime(2024, 1, 20, 3, 5), "001")
    got, _ = _stream(spark, [[_copy(1, "FULLY_CHARGED", "10.00", 1)], [newer], [late]])
    assert got == {("2024-01-10", 14, "AUD"): (Decimal("10.00"), 1), ("2024-01-20", 14, "AUD"): (Decimal("3.00"), 1)}


def test_zone_off_the_hour(spark):
    """03:05 UTC is 13:35 in Adelaide's summer, 03:35 is 14:05; one-hour windows
    are refused there."""
    cfg = AuditConfig(tz="Australia/Adelaide")
    rows = [_copy(1, "FULLY_CHARGED", "2.00", 1), (*_copy(2, "FULLY_CHARGED", "4.00", 1)[:6], dt.datetime(2024, 1, 10, 3, 35), "001")]
    got, _ = _stream(spark, [rows], cfg)
    assert got == {("2024-01-10", 13, "AUD"): (Decimal("2.00"), 1), ("2024-01-10", 14, "AUD"): (Decimal("4.00"), 1)}
    with pytest.raises(ValueError, match="Adelaide"):
        sales_stream.hourly_sales_stream(_copies(spark, rows), cfg=cfg)
    assert sales_stream.whole_hours("Australia/Sydney") and not sales_stream.whole_hours("Asia/Kathmandu")


def _files(path):
    path = path.removeprefix("file:")
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_upserts_equal_one_landing(spark):
    copies = amended_orders_from(read_table(spark, SF001, "events"))
    one, many = scratch_path(spark, "orders-one"), scratch_path(spark, "orders-many")
    upsert_orders(spark, one, copies.drop("copy"), ["source"])
    r = random.Random(3)
    for i in r.sample(range(6), 6):  # any order of arrival
        upsert_orders(spark, many, copies.where(F.pmod(F.xxhash64("number", "copy"), F.lit(6)) == i).drop("copy"), ["source"])
    want, got = (sorted(map(tuple, read_orders(spark, p).select(sorted(copies.drop("copy").columns)).collect())) for p in (one, many))
    assert got == want and len({(r.number) for r in read_orders(spark, many).collect()}) == len(want)
    assert upsert_orders(spark, many, copies.where("false").drop("copy"), ["source"]) == []


def test_untouched_days_keep_their_files(spark):
    path = scratch_path(spark, "orders-days")
    copies = amended_orders_from(read_table(spark, SF001, "events")).drop("copy")
    upsert_orders(spark, path, copies.where("source <> 'copy-2'"), ["source"])
    before = _files(path)
    last = copies.where("source = 'copy-2'")
    some = [r[0] for r in last.select(F.to_date("created")).distinct().orderBy(1).collect()][1:4:2]
    last = last.where(F.to_date("created").isin(some))
    days = upsert_orders(spark, path, last, ["source"])
    assert days == some and len(some) == 2
    after = _files(path)
    touched = lambda f: any(f"utc_date={d}" in f for d in days)
    assert {f: t for f, t in before.items() if not touched(f)} == {f: t for f, t in after.items() if not touched(f)}
    assert not {f for f in before if touched(f)} & set(after)
    fresh = read_orders(spark, path).where("source = 'copy-2'")
    assert fresh.count() == last.count() > 0


def test_orders_of_one_group_keep_their_own_state(spark):
    """All orders in one group: each is amended, and ends, by itself."""
    day, later = dt.datetime(2024, 1, 10, 3, 5), dt.datetime(2024, 1, 11, 3, 5)
    steps = [
        [_copy(1, "FULLY_CHARGED", "10.00", 1), _copy(2, "NOT_CHARGED", "5.00", 1), (*_copy(3, "FULLY_CHARGED", "2.00", 1)[:6], later, "001")],
        [_copy(2, "FULLY_CHARGED", "5.00", 2), (*_copy(4, "FULLY_CHARGED", "1.00", 1)[:6], dt.datetime(2024, 1, 12, 15, 0), "001")],
        [_copy(1, "FULLY_REFUNDED", "10.00", 2), (*_copy(3, "FULLY_REFUNDED", "2.00", 2)[:6], later, "002"), (None, *_copy(5, "FULLY_CHARGED", "3.00", 1)[1:6], later, "001")],
    ]
    src, base = scratch_path(spark, "group"), scratch_path(spark, "group-out")
    for rows in steps:
        _copies(spark, rows).write.mode("append").parquet(src)
        s = sales_stream.amended_sales_stream(spark.readStream.schema(SCHEMA).parquet(src), "2 days", groups=1)
        path = run_versioned(s, "group", base=base, per_batch=sales_stream.summed_deltas)
    got = {(r.local_date, r.hour): (r.gross, r.orders) for r in sales_stream.hourly_from_deltas(read_versions(spark, path, s.schema)).collect()}
    # Order 1's refund comes after its two days and is dropped; order 3's does not.
    assert got == {
        (day.date(), 14): (Decimal("15.00"), 2), (dt.date(2024, 1, 13), 2): (Decimal("1.00"), 1), (later.date(), 14): (Decimal("3.00"), 1)
    }


class _State:
    """What ``_amend`` uses of a group's state."""

    def __init__(self):
        self.get, self.exists, self.hasTimedOut, self.watermark, self.until = None, False, False, 0, None

    def getCurrentWatermarkMs(self):
        return self.watermark

    def setTimeoutTimestamp(self, at):
        self.until = at

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.get, self.exists = None, False


def test_one_call_amends_many_orders():
    """Python is called by group, not by order; state ends order by order."""
    rows = lambda *r: [pd.DataFrame(r, columns=sales_stream._COPY)]
    state = _State()
    out = list(sales_stream._amend((0,), rows(
        ("1", 0, "a", True, "2024-01-10", 14, "AUD", 100, 1000), ("2", 0, "a", True, "2024-01-10", 14, "AUD", 250, 5000),
        ("3", 0, "a", True, None, -1, "AUD", 7, 0),
    ), state))
    assert sorted(map(tuple, out[0].astype(object).where(out[0].notna(), None).values.tolist()), key=str) == [
        ("2024-01-10", 14, "AUD", 350, 2), (None, None, "AUD", 7, 1)
    ]
    state.hasTimedOut, state.watermark = True, 2000
    assert list(sales_stream._amend((0,), [], state)) == [] and state.exists and state.until == 5001
    state.hasTimedOut = False
    out = list(sales_stream._amend((0,), rows(("2", 0, "b", False, "2024-01-10", 14, "AUD", 250, 5000)), state))
    assert out[0].values.tolist() == [["2024-01-10", 14, "AUD", -250, -1]]
    state.hasTimedOut, state.watermark = True, 6000
    assert list(sales_stream._amend((0,), [], state)) == [] and not state.exists


def test_as_many_groups_at_most(spark):
    """The state's key takes few values however many orders there are."""
    rows = [_copy(i, "FULLY_CHARGED", "1.00", 1) for i in range(300)]
    src = scratch_path(spark, "groups")
    _copies(spark, rows).write.parquet(src)
    s = sales_stream.amended_sales_stream(spark.readStream.schema(SCHEMA).parquet(src), groups=7)
    base = scratch_path(spark, "groups-out")
    path = run_versioned(s, "groups", base=base)
    assert spark.read.format("statestore").load(f"{base}/checkpoint").count() == 7
    out = read_versions(spark, path, s.schema)
    assert out.count() == 7 and out.agg(F.sum("orders")).first()[0] == 300
