"""S3: incremental hourly paid sales (today's chart without re-reading).

``amended_sales_stream`` follows orders through their copies: per order it
keeps what the last copy counted for, and a later copy takes that out again.
Orders lie in groups, so that a batch costs Python calls by group, not by order.
``hourly_sales_stream`` is the cheaper form for feeds whose orders never
change: a repeated row counts once.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator
from zoneinfo import ZoneInfo

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tillscope.config import DEFAULT_CONFIG, PAID_STATUS, AuditConfig
from tillscope.functions.emails import is_test_account
from tillscope.functions.timez import to_local
from tillscope.operators.dedupe import latest_per
from tillscope.sources.order_feed import LANDED
from tillscope.streaming.runtime import instant_to_local, utc_instant


def hourly_sales_stream(orders: DataFrame, watermark: str = "2 hours", cfg: AuditConfig = DEFAULT_CONFIG) -> DataFrame:
    """Paid gross and order count per one-hour window and currency, keyed by the window's
    UTC start, with its local date and hour.

    Tumbling one-hour windows on the UTC instant equal local clock hours only
    where the zone's offsets are whole hours; other zones are refused. On the 25-hour
    fall-back day two windows share one local (date, hour); they stay two
    keyed rows here and ``hourly_from_windows`` sums them.
    """
    spark = orders.sparkSession
    if not whole_hours(cfg.tz):
        raise ValueError(f"one-hour windows don't meet the clock hours of {cfg.tz}; use amended_sales_stream")
    o = orders.where(
        F.col("payment_status").eqNullSafe(F.lit(PAID_STATUS)) & ~is_test_account("email", cfg.test_account)
    )
    o = o.withColumn("_et", utc_instant("created", spark)).withWatermark("_et", watermark)
    # A repeated feed row counts once, as in the batch audits.
    if o.isStreaming:
        o = o.dropDuplicatesWithinWatermark(["number"])
    else:
        order = ["created", *(c for c in (LANDED, "source") if c in o.columns)]
        o = latest_per(o, ["number"], order, ["_et", "currency", "total"])
    g = (
        o.groupBy(F.window("_et", "1 hour").alias("w"), "currency")
        .agg(F.sum("total").cast("decimal(18,2)").alias("gross"), F.count(F.lit(1)).alias("orders"))
    )
    local_start = instant_to_local(F.col("w.start"), spark, cfg.tz)
    session_tz = spark.conf.get("spark.sql.session.timeZone")
    return g.select(
        F.convert_timezone(F.lit(session_tz), F.lit("UTC"), F.col("w.start").cast("timestamp_ntz")).alias(
            "window_start"
        ),
        F.to_date(local_start).alias("local_date"),
        F.hour(local_start).alias("hour"),
        "currency",
        "gross",
        "orders",
    )


def hourly_from_windows(windows: DataFrame) -> DataFrame:
    """Final windows -> one row per local (date, hour) and currency."""
    return windows.groupBy("local_date", "hour", "currency").agg(
        F.sum("gross").cast("decimal(18,2)").alias("gross"), F.sum("orders").cast("bigint").alias("orders")
    )


def whole_hours(tz: str) -> bool:
    """Whether the zone's offsets of the last years and the next are whole hours."""
    days = (dt.datetime(y, m, 15, tzinfo=ZoneInfo(tz)) for y in range(2000, dt.date.today().year + 2) for m in range(1, 13))
    return all(d.utcoffset().total_seconds() % 3600 == 0 for d in days)


DELTA = "local_date date, hour int, currency string, gross decimal(18,2), orders long"
_OUT = "local_date string, hour int, currency string, cents long, orders long"
#: Groups of orders, by hash of the number: an order's state lies in its group's,
#: and Python is called once a group and batch.
GROUPS = 1 << 12
#: The orders of a group, packed: of each its number, its last copy's place among
#: the copies, what that counts for, and when its state ends.
_STATE = "orders binary"
_COPY = ["number", "landed", "source", "paid", "local_date", "hour", "currency", "cents", "until"]
_PACKED = pa.schema(list(zip(
    _COPY, (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True
)))


def _pack(orders: dict[str, tuple]) -> bytes:
    columns = zip(*((number, *c) for number, c in orders.items()), strict=True)
    batch = pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _PACKED, strict=True)], schema=_PACKED)
    return batch.serialize().to_pybytes()


def _unpack(packed: bytes) -> dict[str, tuple]:
    batch = pa.ipc.read_record_batch(pa.py_buffer(packed), _PACKED)
    return {number: c for number, *c in zip(*(v.to_pylist() for v in batch.columns), strict=True)}


def _amend(key: tuple, copies: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A group's new copies: out goes what the last one of their orders counted
    for, in comes what the newest counts for, added up."""
    now = state.getCurrentWatermarkMs()
    orders = _unpack(bytes(state.get[0])) if state.exists else {}
    fresh: dict[str, tuple] = {}
    for rows in copies if not state.hasTimedOut else ():
        for number, *c in zip(*(rows[name].tolist() for name in _COPY), strict=True):
            best = fresh.get(number)
            # Copies of one place: paid before unpaid, then the larger amount.
            if best is None or (c[0], c[1], c[2], c[6]) > (best[0], best[1], best[2], best[6]):
                fresh[number] = (*c[:7], max(c[7], best[7]) if best else c[7])
            elif c[7] > best[7]:
                fresh[number] = (*best[:7], c[7])
    sums: dict[tuple, list[int]] = {}
    for number, new in fresh.items():
        old = orders.get(number)
        best = new if old is None or (new[0], new[1]) >= (old[0], old[1]) else old
        orders[number] = (*best[:7], max(new[7], now) + 1)
        for c, sign in ((old, -1), (best, 1)) if old is None or tuple(best[:7]) != tuple(old[:7]) else ():
            if c is not None and c[2]:
                total = sums.setdefault(tuple(c[3:6]), [0, 0])
                total[0] += sign * c[6]
                total[1] += sign
    orders = {number: c for number, c in orders.items() if c[7] >= now}
    if orders:
        state.update((_pack(orders),))
        state.setTimeoutTimestamp(max(min(c[7] for c in orders.values()), now + 1))
    else:
        state.remove()
    if sums:
        out = pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["local_date", "hour", "currency", "cents", "orders"])
        out["hour"] = out["hour"].where(out["hour"] >= 0).astype("Int32")
        yield out


def amended_sales_stream(
    orders: DataFrame, overlap: str = "2 days", cfg: AuditConfig = DEFAULT_CONFIG, groups: int = GROUPS
) -> DataFrame:
    """Changes of the paid gross and order count of a local (date, hour) and
    currency, as copies of orders arrive: negative for what an older copy had
    counted for. Their sum over all batches is A7 on each order's last copy
    (by landing time, then ``source``, where the feed has them).

    ``overlap``: how long after it was created an order may still be amended;
    its state is dropped then, and copies later than that are dropped as late.
    The local date and hour come from each order itself, so any zone will do.

    ``groups``: the state is kept by so many groups of orders. The checkpoint
    keeps the number for good; a batch writes the state of the groups it meets,
    so it should be well over the state partitions, and leave a group some
    thousands of orders at most.
    """
    has = orders.columns
    o = orders.withColumn("_et", utc_instant("created", orders.sparkSession)).withWatermark("_et", overlap)
    local = to_local("created", cfg.tz)
    paid = F.col("payment_status").eqNullSafe(F.lit(PAID_STATUS)) & ~is_test_account("email", cfg.test_account)
    rows = o.select(
        F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int").alias("orders_group"), F.col("number").cast("string").alias("number"), "_et",
        (F.coalesce(F.unix_micros(F.col(LANDED).cast("timestamp")), F.lit(0)) if LANDED in has else F.lit(0)).cast("long").alias("landed"),
        F.coalesce(F.col("source") if "source" in has else F.lit(None), F.lit("")).alias("source"),
        paid.alias("paid"), F.to_date(local).cast("string").alias("local_date"), F.coalesce(F.hour(local), F.lit(-1)).alias("hour"),
        F.coalesce("currency", F.lit(cfg.default_currency)).alias("currency"),
        (F.coalesce("total", F.lit(0)) * 100).cast("long").alias("cents"), F.coalesce(F.unix_millis("_et"), F.lit(0)).alias("until"),
    )
    out = rows.groupBy("orders_group").applyInPandasWithState(_amend, _OUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return out.select(
        F.col("local_date").cast("date").alias("local_date"), "hour", "currency",
        (F.col("cents").cast("decimal(20,0)") / 100).cast("decimal(18,2)").alias("gross"), "orders",
    )


def summed_deltas(deltas: DataFrame) -> DataFrame:
    """Deltas added up by local (date, hour) and currency; one batch's, to be
    written, or all that were."""
    return hourly_from_windows(deltas)


def hourly_from_deltas(deltas: DataFrame) -> DataFrame:
    """All written deltas -> one row per local (date, hour) and currency that
    has paid orders left."""
    return summed_deltas(deltas).where("orders <> 0")
