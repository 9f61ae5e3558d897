"""Column helpers and single-request forms against their bulk versions."""

import datetime as dt

from pyspark.sql import functions as F

from tillscope.config import DEFAULT_CONFIG
from tillscope.functions.labels import display_time, shop_filter, stage_label
from tillscope.operators import profiles


def test_stage_label_and_display_time(spark):
    df = spark.createDataFrame(
        [("purchase_completed", dt.datetime(2024, 10, 5, 15, 30, 0)), (None, None)], "s string, ts timestamp_ntz"
    )
    got = [tuple(r) for r in df.select(stage_label("s"), display_time("ts", "Australia/Sydney")).collect()]
    # 15:30 UTC on 10-05 is 01:30 AEST on 10-06 (before the 02:00 jump)
    assert got == [("Purchased", "06 Oct, 01:30:00"), ("none", "N/A")]


def test_shop_filter_override(spark):
    df = spark.createDataFrame(
        [("care.example.com", "/patient/1"), ("care.example.com", "/other"), ("x.example.com", "/")],
        "host string, pathname string",
    )
    assert df.where(shop_filter(DEFAULT_CONFIG)).count() == 1
    assert df.where(shop_filter(DEFAULT_CONFIG, hosts_override=("care.example.com ",))).count() == 2


def test_replays_single_day_equals_bulk(spark, fx01):
    d = dt.date(2024, 1, 15)
    emails = fx01.logins.select(F.replace("email", F.lit("[at]"), F.lit("@")).alias("email")).distinct()
    one = profiles.session_replays_for_day(fx01.activity, emails, d)
    req = emails.select(F.lit(d).alias("local_date"), "email")
    bulk = profiles.session_replays(fx01.activity, req)
    cols = ["local_date", "email", "session_id", "start_time", "url"]
    assert one.count() > 0
    assert one.select(cols).exceptAll(bulk.select(cols)).count() == 0
    assert bulk.select(cols).exceptAll(one.select(cols)).count() == 0


def test_customer_profile_nested(fx01):
    prof = profiles.customer_profile(fx01.customers, fx01.shop_orders, 10)
    flat = profiles.customer_order_history(fx01.customers, fx01.shop_orders, 10)
    assert prof.count() == fx01.customers.count()
    assert prof.select(F.max(F.size("history"))).first()[0] == 10
    n = prof.select(F.sum(F.size("history"))).first()[0]
    assert n == flat.where(F.col("order_rank").isNotNull()).count()
    r = prof.where(F.size("history") > 1).first()
    dates = [h["date"] for h in r.history]
    assert dates == sorted(dates, reverse=True)  # newest first


def test_activity_from_event_log_map_and_json(spark):
    from tillscope.sources.fixtures import activity_from_event_log

    t = dt.datetime(2024, 1, 10, 1, 0, 0)
    props = {"$session_id": "s1", "$host": "shop.example.com", "$pathname": "/", "$current_url": "https://shop.example.com/"}
    as_map = spark.createDataFrame(
        [(1, t, "cart_added", 5, props, {"email": "a@x"})],
        "event_id bigint, ts timestamp_ntz, event string, person_id bigint, "
        "properties map<string,string>, person_properties map<string,string>",
    )
    as_json = spark.createDataFrame(
        [(1, t, "cart_added", 5, '{"$session_id": "s1", "$host": "shop.example.com", "$pathname": "/", '
          '"$current_url": "https://shop.example.com/"}', '{"email": "a@x"}')],
        "event_id bigint, ts timestamp_ntz, event string, person_id bigint, properties string, person_properties string",
    )
    a = [tuple(r) for r in activity_from_event_log(as_map).collect()]
    b = [tuple(r) for r in activity_from_event_log(as_json).collect()]
    assert a == b == [(1, t, "cart_added", 5, "a@x", "s1", "shop.example.com", "/", "https://shop.example.com/")]
