"""Core building blocks against brute force on small random inputs."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillscope.operators.dedupe import latest_per
from tillscope.operators.joins import band_semi_join
from tillscope.streaming.live_stream import sliding_from_panes

SETTINGS = settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
T0 = dt.datetime(2024, 1, 1)

rows_st = st.lists(
    st.tuples(
        st.sampled_from(["a", "b", "c"]),
        st.one_of(st.none(), st.integers(0, 5)),  # order value with NULLs and ties
        st.integers(0, 10_000),
    ),
    min_size=1,
    max_size=30,
    unique_by=lambda r: r[2],  # id is unique
)


@SETTINGS
@given(rows=rows_st, nulls_first=st.booleans())
def test_latest_per_brute(spark, rows, nulls_first):
    df = spark.createDataFrame(rows, "k string, t int, id int")
    got = {r.k: r.id for r in latest_per(df, ["k"], ["t", "id"], ["id"], nulls_first=nulls_first).collect()}

    def rank(r):
        t = r[1]
        if nulls_first:
            return (t is None, -1 if t is None else t, r[2])
        return (t is not None, -1 if t is None else t, r[2])

    want = {}
    for r in rows:
        if r[0] not in want or rank(r) > rank(want[r[0]]):
            want[r[0]] = r
    assert got == {k: v[2] for k, v in want.items()}


@SETTINGS
@given(
    left=st.lists(st.tuples(st.integers(0, 20), st.sampled_from(["x", "y", "z"])), max_size=15),
    right=st.lists(st.tuples(st.integers(0, 20), st.sampled_from(["x", "y", "z"])), max_size=15),
    lo=st.integers(0, 3),
    width=st.integers(0, 8),
)
def test_band_semi_join_brute(spark, left, right, lo, width):
    hi = lo + width
    base = dt.date(2024, 1, 1)
    L = spark.createDataFrame([(i, base + dt.timedelta(days=d), k) for i, (d, k) in enumerate(left)], "i int, d date, k string")
    R = spark.createDataFrame([(base + dt.timedelta(days=d), k) for d, k in right], "rd date, k string")
    got = sorted(r.i for r in band_semi_join(L, R, "d", "rd", "k", lo, hi).collect())
    want = sorted(i for i, (d, k) in enumerate(left) if any(k == k2 and lo <= d - d2 <= hi for d2, k2 in right))
    assert got == want


@SETTINGS
@given(
    events=st.lists(
        st.tuples(st.integers(0, 60 * 20), st.integers(1, 3)),  # second offset within 20 minutes, person
        min_size=1,
        max_size=25,
    )
)
def test_panes_equal_direct_sliding(spark, events):
    rows = [(i, T0 + dt.timedelta(seconds=s), p, f"u{p}@x", f"https://x/{i}", "shop.example.com") for i, (s, p) in enumerate(events)]
    ev = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, person_id int, email string, current_url string, host string")
    order = F.struct("ts", "event_id")
    direct = (
        ev.groupBy(F.window(F.col("ts").cast("timestamp"), "5 minutes", "1 minute").alias("w"), "person_id", "email")
        .agg(F.max("ts").alias("last_seen"), F.max_by("current_url", order).alias("current_url"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "person_id", "email", "last_seen", "current_url")
    )
    panes = (
        ev.groupBy(F.window(F.col("ts").cast("timestamp"), "1 minute").alias("w"), "person_id", "email")
        .agg(F.max(F.struct("ts", "event_id", "current_url", "host")).alias("last"))
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("pane_start"),
            "person_id",
            "email",
            F.col("last.ts").alias("last_seen"),
            F.col("last.event_id").alias("last_event_id"),
            F.col("last.current_url").alias("current_url"),
            F.col("last.host").alias("host"),
        )
    )
    assembled = sliding_from_panes(panes, 5, 1).select("window_start", "person_id", "email", "last_seen", "current_url")
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, assembled.collect()))
