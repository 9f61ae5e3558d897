"""Key bitmaps: no key of the set is lost, few others pass, and the funnel of a
day range shuffles its logins' sessions only."""

from collections import Counter

from pyspark.sql import functions as F

from tests.conftest import SF01
from tests.test_plans import plan_text
from tillscope.functions.membership import key_bitmap, may_contain
from tillscope.operators import funnel, logins
from tillscope.plans import QUERIES
from tillscope.sources.fixtures import Fixtures

D1, D2 = "2024-01-10", "2024-01-11"


def test_no_key_is_lost_and_few_others_pass(spark):
    keys = spark.range(0, 20000, 7).select(F.col("id").alias("a"), (F.col("id") % 5).cast("string").alias("b"))
    rows = spark.range(20000).select(F.col("id").alias("a"), (F.col("id") % 5).cast("string").alias("b"))
    kept = {r.a for r in rows.where(may_contain(key_bitmap(keys, "a", "b"), F.col("a"), F.col("b"))).collect()}
    want = {r.a for r in keys.collect()}
    assert want <= kept and len(kept - want) < 50
    assert rows.where(may_contain(key_bitmap(keys.where("false"), "a", "b"), F.col("a"), F.col("b"))).count() == 0


def test_funnel_of_a_day_range(spark):
    fx = Fixtures(spark, SF01)
    one = fx.logins.where("login_id % 10 = 0")  # few of the day's visitors log in
    got = funnel.login_funnel(one, fx.activity, D1, D2)
    text = plan_text(got)
    assert "bitmap_construct_agg" in text and text.index("bitmap") > 0
    # The same rows as without the filter: the whole range's funnel, cut to the days.
    whole = funnel.login_funnel(one, fx.activity).where(F.col("local_date").between(D1, D2))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, whole.collect())) and got.count() > 0
    lg = logins.latest_logins(one, D1, D2, False)
    keys = lg.select(F.col("local_date").alias("act_date"), F.lower(F.replace("email", F.lit("[at]"), F.lit("@"))).alias("email_key"))
    every = funnel.session_stage_rollup(fx.activity, None, D1, D2)
    sent = every.where(may_contain(key_bitmap(keys, "act_date", "email_key"), F.col("act_date"), F.col("email_key")))
    assert sent.count() < 0.5 * every.count()


def test_registered_day_range_has_the_filter(spark):
    assert "bitmap_construct_agg" in plan_text(QUERIES["login_funnel_days"](spark, SF01))
    assert "bitmap_construct_agg" not in plan_text(QUERIES["login_funnel"](spark, SF01))
