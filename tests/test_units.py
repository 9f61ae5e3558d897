"""Hand-written rows: DST days, NULLs, case variants, ties, empty days."""

import datetime as dt

from pyspark.sql import functions as F

from tillscope.functions.emails import is_test_account, normalize_email
from tillscope.functions.timez import date_spine, local_date, local_day_filter, utc_start_of_local_day
from tillscope.operators import intent, logins, purchases, recovery
from tillscope.operators.dedupe import latest_per

TS = "timestamp_ntz"


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_dst_day_bounds():
    tz = "Australia/Sydney"
    # 2024-04-07 is a 25-hour day, 2024-10-06 a 23-hour day.
    a, b = utc_start_of_local_day(dt.date(2024, 4, 7), tz), utc_start_of_local_day(dt.date(2024, 4, 8), tz)
    assert (a, b - a) == (ts("2024-04-06 13:00:00"), dt.timedelta(hours=25))
    a, b = utc_start_of_local_day(dt.date(2024, 10, 6), tz), utc_start_of_local_day(dt.date(2024, 10, 7), tz)
    assert (a, b - a) == (ts("2024-10-05 14:00:00"), dt.timedelta(hours=23))


def test_local_day_filter_matches_converted_date(spark):
    tz = "Australia/Sydney"
    rows = [
        (ts("2024-04-06 12:59:59"),),  # 04-06 23:59:59 local (AEDT)
        (ts("2024-04-06 13:00:00"),),  # 04-07 00:00 local
        (ts("2024-04-06 15:30:00"),),  # 02:30 AEDT, before fall-back
        (ts("2024-04-06 16:30:00"),),  # 02:30 AEST, after fall-back
        (ts("2024-04-07 13:59:00"),),  # 04-07 23:59 AEST
        (ts("2024-04-07 14:00:00"),),  # 04-08 00:00 local
        (ts("2024-10-05 13:59:59"),),  # 10-05 23:59:59 AEST
        (ts("2024-10-05 14:00:00"),),  # 10-06 00:00
        (ts("2024-10-05 16:30:00"),),  # 03:30 AEDT (02:xx skipped)
        (ts("2024-10-06 12:59:00"),),  # 10-06 23:59 AEDT
        (ts("2024-10-06 13:00:00"),),  # 10-07 00:00
    ]
    df = spark.createDataFrame(rows, f"ts {TS}")
    for d in (dt.date(2024, 4, 7), dt.date(2024, 10, 6)):
        by_bounds = sorted(r.ts for r in df.where(local_day_filter("ts", d, d, tz)).collect())
        by_convert = sorted(r.ts for r in df.where(local_date("ts", tz) == F.lit(d)).collect())
        assert by_bounds == by_convert
    assert df.where(local_day_filter("ts", dt.date(2024, 4, 7), dt.date(2024, 4, 7), tz)).count() == 4
    assert df.where(local_day_filter("ts", dt.date(2024, 10, 6), dt.date(2024, 10, 6), tz)).count() == 3


def test_local_day_filter_pushes_down(spark):
    from tests.conftest import SF001
    from tillscope.functions.timez import where_local_days
    from tillscope.session import scratch_path
    from tillscope.sources.fixtures import Fixtures
    from tillscope.sources.landing import land_events

    landed = Fixtures(spark, SF001, events=land_events(spark, SF001, "v1", scratch_path(spark, "landed-unit")))
    plan = where_local_days(landed.logins, "created_at", "2024-01-29", "2024-01-29", "Australia/Sydney")
    text = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(ts,2024-01-28T13:00)" in text and "LessThan(ts,2024-01-29T13:00)" in text
    # the landed event log is partitioned by UTC date: the range prunes partitions too
    assert "PartitionFilters: [isnotnull(utc_date" in text
    assert "(utc_date#" in text and ">= 2024-01-28)" in text and "<= 2024-01-29)" in text


def test_normalize_and_test_account(spark):
    df = spark.createDataFrame(
        [(" A[at]x[at]y ",), ("User7[at]Example.com",), (None,), ("user7@example.com ",)], "email string"
    )
    got = [tuple(r) for r in df.select(normalize_email("email"), is_test_account("email", "user7@example.com")).collect()]
    assert got == [("a@x@y", False), ("user7@example.com", True), (None, False), ("user7@example.com", True)]


def test_latest_per_ties_and_nulls(spark):
    df = spark.createDataFrame(
        [("a", ts("2024-01-01 00:00:00"), 1, "x"), ("a", ts("2024-01-01 00:00:00"), 2, "y"), ("b", None, 3, "n"),
         ("b", ts("2024-01-02 00:00:00"), 4, "m")],
        f"k string, t {TS}, id int, v string",
    )
    last = {r.k: r.v for r in latest_per(df, ["k"], ["t", "id"], ["v"]).collect()}
    assert last == {"a": "y", "b": "m"}  # equal times: larger id wins; NULL time ranks last
    first_null = {r.k: r.v for r in latest_per(df, ["k"], ["t", "id"], ["v"], nulls_first=True).collect()}
    assert first_null == {"a": "y", "b": "n"}  # NULL ranks first (PostgreSQL DESC)


def _logins(spark, rows):
    return spark.createDataFrame(rows, f"login_id bigint, email string, allowance int, created_at {TS}")


def test_login_dedupe_case_sensitive_and_allowance_before(spark):
    lg = _logins(
        spark,
        [
            (1, "Ann[at]x.com", 5, ts("2024-01-10 01:00:00")),
            (2, "ann[at]x.com", 0, ts("2024-01-10 02:00:00")),
            (3, "ann[at]x.com", 3, ts("2024-01-10 01:30:00")),
            (4, "user7[at]example.com", 9, ts("2024-01-10 01:00:00")),
            (5, None, 2, ts("2024-01-10 01:00:00")),
        ],
    )
    carts = spark.createDataFrame(
        [(1, "ANN[at]x.com", True, ts("2024-01-01 00:00:00")), (2, "ann[at]x.com", None, ts("2024-01-02 00:00:00"))],
        f"cart_id bigint, email string, is_converted boolean, created_at {TS}",
    )
    plans = spark.createDataFrame([("ann@x.com", ts("2023-12-01 00:00:00"))], f"email string, created_at {TS}")
    d = dt.date(2024, 1, 10)
    a = {(r.email, r.allowance, r.order_count) for r in logins.login_audit(lg, carts, plans, d, d).collect()}
    # two case variants -> two rows; NULL e-mail kept; test account removed; NULL is_converted not counted
    assert a == {("Ann[at]x.com", 5, 1), ("ann[at]x.com", 0, 1), (None, 2, 0)}
    b = {(r.email, r.allowance) for r in logins.login_audit(lg, carts, plans, d, d, with_allowance=True).collect()}
    assert b == {("Ann[at]x.com", 5), ("ann[at]x.com", 3), (None, 2)}  # latest *with* allowance
    no = {r.email for r in logins.login_no_orders(logins.login_audit(lg, carts, plans, d, d)).collect()}
    # the NULL-e-mail login matches no cart (no last order) and has allowance 2 > 0
    assert no == {None}


def _orders(spark, rows):
    return spark.createDataFrame(
        rows,
        f"number string, email string, payment_status string, status string, total decimal(18,2), currency string, created {TS}",
    )


def test_unpaid_hides_payers_and_null_email(spark):
    from decimal import Decimal as Dc

    o = _orders(
        spark,
        [
            ("1", "a@x", "NOT_CHARGED", "UNFULFILLED", Dc("10.00"), "AUD", ts("2024-01-10 01:00:00")),
            ("2", "a@x", "FULLY_CHARGED", "FULFILLED", Dc("20.00"), "AUD", ts("2024-01-10 02:00:00")),
            ("3", "b@x", None, "FULFILLED", Dc("5.00"), "AUD", ts("2024-01-10 02:00:00")),
            ("4", None, "NOT_CHARGED", None, Dc("7.00"), "AUD", ts("2024-01-10 03:00:00")),
            ("5", None, "FULLY_CHARGED", None, Dc("1.00"), "AUD", ts("2024-01-10 03:00:00")),
            ("5", None, "FULLY_CHARGED", None, Dc("1.00"), "AUD", ts("2024-01-10 03:00:00")),
        ],
    )
    p = purchases.purchases(o)
    assert p.count() == 5  # duplicate number collapsed
    unpaid = {r.number for r in purchases.purchase_status_filter(p, "unpaid").collect()}
    assert unpaid == {"3"}  # NULL status is unpaid; NULL e-mail with a paid NULL-e-mail order is hidden
    k = purchases.purchase_kpis(p, date_spine(spark, "2024-01-10", "2024-01-10")).first()
    assert (k.total_paid, k.paid_count, k.true_unpaid_total) == (Dc("21.00"), 2, Dc("5.00"))
    assert k.prev_aov is None and k.prev_total_paid == Dc("0.00")


def test_zero_allowance_day_and_empty_day(spark):
    lg = _logins(spark, [(1, "a[at]x", 0, ts("2024-01-10 01:00:00"))])
    o = _orders(spark, [])
    p = purchases.purchases(o)
    spine = date_spine(spark, "2024-01-10", "2024-01-11")
    got = {r.local_date.isoformat(): tuple(r)[1:] for r in intent.daily_intent_audit(lg, p, spine).collect()}
    assert got == {"2024-01-10": (0, 1, 0, 0, 0, 0), "2024-01-11": (0, 0, 0, 0, 0, 0)}


def test_percent_rounding_order(spark):
    # 23/40*100 = 57.49999999999999 in doubles -> 57 (not 58)
    rows = [(dt.date(2024, 1, 1), 0, 40, 40, 23, 57, 0)]
    daily = spark.createDataFrame(
        rows,
        "local_date date, total_orders bigint, total_logins bigint, total_logins_with_allowance bigint, "
        "did_not_buy bigint, non_conversion_percent bigint, logins_with_unfulfilled_orders bigint",
    )
    r = intent.intent_rolling_rate(daily).first()
    assert (r.rate_day, r.rate_7d, r.rate_28d) == (57, 57, 57)


def test_abandoned_latest_allowance_nulls_first(spark):
    lg = _logins(
        spark,
        [(1, "a[at]x", 4, ts("2024-01-10 01:00:00")), (2, "A[at]x", 9, None), (3, "b[at]x", 2, ts("2024-01-09 00:00:00"))],
    )
    carts = spark.createDataFrame(
        [
            (10, "a[at]x", False, ts("2024-01-10 01:00:00")),
            (11, "a[at]x", False, ts("2024-01-10 02:00:00")),
            (12, "b[at]x", None, ts("2024-01-10 02:00:00")),
            (13, "b[at]x", True, ts("2024-01-10 03:00:00")),
        ],
        f"cart_id bigint, email string, is_converted boolean, created_at {TS}",
    )
    r = recovery.abandoned_carts(carts, lg, "2024-01-10", "2024-01-10").collect()
    assert [(x.email, x.days_allowance_remaining, x.cart_created) for x in r] == [
        ("a[at]x", 9, ts("2024-01-10 02:00:00"))
    ]


def test_hourly_history_dst_days(spark):
    from decimal import Decimal as Dc

    o = _orders(
        spark,
        [
            ("1", "a@x", "FULLY_CHARGED", "FULFILLED", Dc("10.00"), "AUD", ts("2024-04-06 15:30:00")),  # 04-07 02:30 AEDT
            ("2", "b@x", "FULLY_CHARGED", "FULFILLED", Dc("5.00"), "AUD", ts("2024-04-06 16:30:00")),  # 04-07 02:30 AEST
            ("3", "c@x", "FULLY_CHARGED", "FULFILLED", Dc("2.00"), "AUD", ts("2024-10-05 16:30:00")),  # 10-06 03:30 AEDT
        ],
    )
    p = purchases.purchases(o)
    spine = spark.createDataFrame([(dt.date(2024, 4, 7),), (dt.date(2024, 10, 6),)], "local_date date")
    h = {(r.local_date.isoformat(), r.hour): r.today for r in purchases.hourly_sales_history(p, spine).collect()}
    assert len(h) == 48
    assert h[("2024-04-07", 2)] == Dc("15.00")  # the repeated hour holds both UTC hours
    assert h[("2024-10-06", 2)] == Dc("0.00") and h[("2024-10-06", 3)] == Dc("2.00")  # 02:xx does not exist


def test_weekday_by_currency(spark):
    from decimal import Decimal as Dc

    o = _orders(
        spark,
        [
            ("1", "a@x", "FULLY_CHARGED", "FULFILLED", Dc("10.00"), "AUD", ts("2024-01-10 01:00:00")),
            ("2", "b@x", "FULLY_CHARGED", "FULFILLED", Dc("7.00"), "NZD", ts("2024-01-10 02:00:00")),
        ],
    )
    p = purchases.purchases(o)
    spine = date_spine(spark, "2024-01-10", "2024-01-10")
    one = purchases.weekday_comparison(p, spine, 23).where("is_today").first()
    assert (one.gross_sales, one.order_count, one.currency) == (Dc("17.00"), 2, "NZD")  # latest order's currency
    split = purchases.weekday_comparison(p, spine, 23, by_currency=True).where("is_today").collect()
    assert sorted((r.currency, r.gross_sales, r.order_count) for r in split) == [("AUD", Dc("10.00"), 1), ("NZD", Dc("7.00"), 1)]


def test_repeated_orders_fill_one_place_each(spark):
    from tillscope.operators import profiles

    cust = spark.createDataFrame([("a@x", "A", "B"), ("c@x", None, None)], "email string, first_name string, last_name string")
    rows = [(str(i), "a@x", "FULLY_CHARGED", "FULFILLED", None, "AUD", ts(f"2024-01-{i + 1:02d} 00:00:00")) for i in range(12)]
    o = spark.createDataFrame(rows, "number string, email string, payment_status string, status string, total decimal(18,2), currency string, created timestamp_ntz")
    once = profiles.customer_order_history(cust, o, 10)
    twice = profiles.customer_order_history(cust, o.unionByName(o), 10)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    nested = {r.email: [x.number for x in r.history] for r in profiles.customer_profile(cust, o.unionByName(o), 10, cust).collect()}
    assert nested == {"a@x": [str(i) for i in range(11, 1, -1)], "c@x": []}


def test_unmatched_keys_keep_their_rows(spark):
    """Logins without carts, plans or contacts; carts without logins."""
    from tillscope.operators import profiles

    lg = spark.createDataFrame([(1, "u1[at]x", 5, ts("2024-01-10 01:00:00"))], "login_id bigint, email string, allowance int, created_at timestamp_ntz")
    carts = spark.createDataFrame([(1, "u2[at]x", False, ts("2024-01-10 01:00:00"))], "cart_id bigint, email string, is_converted boolean, created_at timestamp_ntz")
    plans = spark.createDataFrame([("u3@x", ts("2024-01-01 00:00:00"))], "email string, created_at timestamp_ntz")
    row = logins.login_audit(lg, carts, plans).first()
    assert (row.order_count, row.last_order_at, row.tp_date) == (0, None, None)
    assert recovery.abandoned_carts(carts, lg).first().days_allowance_remaining is None
    contacts = spark.createDataFrame([], "id string, full_name string, first_name string, last_name string, email string, phone string")
    c = profiles.contact_profile(lg.select("email"), contacts).first()
    assert (c.id, c.name, c.phone, c.crm_url) == (None, "Not Found", "N/A", None)


def test_shared_folder_is_never_this_machines_on_a_cluster():
    import pytest

    from tillscope.session import shared_dir

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())
    Session.conf["spark.checkpoint.dir"] = "hdfs://shared/ckpt"
    assert shared_dir(Session()) == "hdfs://shared/ckpt"


def test_newest_first(spark):
    from tillscope.audits import ShopAudits

    p = spark.createDataFrame([("1", ts("2024-01-01 00:00:00")), ("2", ts("2024-01-02 00:00:00")), ("3", None)], "number string, purchase_time timestamp_ntz")
    assert [r.number for r in ShopAudits.newest_first(p, "purchases").collect()] == ["2", "1", "3"]


def test_currencies_are_never_added_up(spark):
    from decimal import Decimal

    from tillscope.streaming.sales_stream import hourly_from_windows, hourly_sales_stream

    D = Decimal
    at = lambda h, d=10: ts(f"2024-01-{d} 0{h}:00:00")
    rows = [
        ("1", "a@x", "FULLY_CHARGED", "FULFILLED", D("10.00"), "AUD", at(1)),
        ("2", "b@x", "FULLY_CHARGED", "FULFILLED", D("7.00"), "NZD", at(1)),
        ("3", "b@x", "NOT_CHARGED", "FULFILLED", D("5.00"), "AUD", at(2)),  # b paid that day, in another currency
        ("4", "c@x", "NOT_CHARGED", "FULFILLED", D("3.00"), "NZD", at(2)),
        ("5", "c@x", "FULLY_CHARGED", "FULFILLED", D("2.00"), None, at(1, 12)),
    ]
    o = spark.createDataFrame(rows, "number string, email string, payment_status string, status string, total decimal(18,2), currency string, created timestamp_ntz")
    p = purchases.purchases(o)
    spine = date_spine(spark, "2024-01-10", "2024-01-13")
    k = {(r.local_date.day, r.currency): (r.total_paid, r.true_unpaid_total, r.prev_total_paid) for r in purchases.purchase_kpis(p, spine).collect()}
    z = D("0.00")
    assert k == {
        (10, "AUD"): (D("10.00"), z, z), (10, "NZD"): (D("7.00"), D("3.00"), z),
        (11, "AUD"): (z, z, D("10.00")), (11, "NZD"): (z, z, D("7.00")),
        (12, "AUD"): (D("2.00"), z, z), (13, "AUD"): (z, z, D("2.00")),
    }
    h = purchases.hourly_sales_history(p, spine)
    assert h.count() == 24 * 6
    last = {(r.local_date.day, r.currency): (r.today, r.yesterday) for r in purchases.hourly_cumulative_sales(h).where("hour = 23").collect()}
    assert last[(10, "NZD")] == (D("7.00"), z) and last[(11, "NZD")] == (z, D("7.00")) and last[(12, "AUD")] == (D("2.00"), z)
    s = {(r.hour, r.currency): r.gross for r in hourly_from_windows(hourly_sales_stream(o)).where("local_date = '2024-01-10'").collect()}
    assert s == {(12, "AUD"): D("10.00"), (12, "NZD"): D("7.00")}
    w = purchases.weekday_comparison(p, date_spine(spark, "2024-01-10", "2024-01-10"), 23, 1, by_currency=True)
    assert {(r.currency, r.gross_sales) for r in w.collect()} == {("AUD", D("10.00")), ("NZD", D("7.00"))}
