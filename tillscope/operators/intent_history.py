"""A20 from stored sums: the trailing rates of a day by looking up two others.

Each day keeps the running totals of its two counts since the first day, one
partition a day. A trailing window's sum is the difference of two days'
totals, so a rate of 7 or 28 days reads three days whatever the window, and a
new day reads the day before it and nothing else.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillscope.operators.intent import RATE_DAYS, _percent
from tillscope.sources.sinks import write_parquet

WEEK = 7
COUNTS = {"allowance_total": "total_logins_with_allowance", "no_buy_total": "did_not_buy"}
SCHEMA = "rate_day long, allowance_total long, no_buy_total long, local_date date"


def running_totals(daily: DataFrame) -> DataFrame:
    """Running totals of dense daily rows: within years by a window, years by
    the sums of those before (a row a year spread to the later ones)."""
    days = daily.withColumn("_y", F.year("local_date"))
    along = Window.partitionBy("_y").orderBy("local_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    years = days.groupBy("_y").agg(*(F.sum(c).alias(t) for t, c in COUNTS.items()))
    last = years.agg(F.max("_y")).scalar()
    later = years.withColumn("_last", last).where("_y < _last").select(F.explode(F.expr("sequence(_y + 1, _last)")).alias("_y"), *COUNTS)
    before = later.groupBy("_y").agg(*(F.sum(t).alias(f"_{t}") for t in COUNTS))
    rows = days.select("_y", "local_date", "non_conversion_percent", *(F.sum(c).over(along).alias(t) for t, c in COUNTS.items()))
    totals = [(F.col(t) + F.coalesce(F.col(f"_{t}"), F.lit(0))).cast("long").alias(t) for t in COUNTS]
    return rows.join(before, "_y", "left").select(F.col("non_conversion_percent").cast("long").alias("rate_day"), *totals, "local_date")


def land_history(daily: DataFrame, path: str) -> str:
    """Write the totals of all of ``daily`` (dense, one row a day)."""
    return write_parquet(running_totals(daily), path, partition_by="local_date")


def history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def day_before(spark: SparkSession, path: str, day: dt.date) -> DataFrame:
    """The stored day before ``day``: one partition."""
    return history(spark, path).where(F.col("local_date") == F.lit(day - dt.timedelta(days=1)))


def append_day(spark: SparkSession, path: str, daily: DataFrame, day: dt.date) -> str:
    """Store ``day`` (its A18 row is in ``daily``) after the day before it; a
    day stored again replaces itself. Days have to follow each other."""
    row = daily.where(F.col("local_date") == F.lit(day)).select(
        F.lit(1).alias("_one"), F.col("non_conversion_percent").cast("long").alias("rate_day"), *(F.col(c).alias(f"_{t}") for t, c in COUNTS.items())
    )
    old = day_before(spark, path, day).select(F.lit(1).alias("_one"), *COUNTS)
    if old.isEmpty():
        raise ValueError(f"the day before {day} is not stored")
    new = row.join(old, "_one").select(
        "rate_day", *((F.col(t) + F.col(f"_{t}")).cast("long").alias(t) for t in COUNTS), F.lit(day).alias("local_date")
    )
    return write_parquet(new, path, partition_by="local_date")


def rates(spark: SparkSession, path: str, d_from: dt.date | None = None, d_to: dt.date | None = None) -> DataFrame:
    """local_date, rate_day, rate_7d, rate_28d of the stored days [d_from,
    d_to]: each day's totals go to the days that subtract them."""
    stored = history(spark, path)
    if d_from is not None:
        stored = stored.where(F.col("local_date") >= F.lit(d_from - dt.timedelta(days=RATE_DAYS)))
    if d_to is not None:
        stored = stored.where(F.col("local_date") <= F.lit(d_to))
    uses = stored.select("*", F.explode(F.array(F.lit(0), F.lit(WEEK), F.lit(RATE_DAYS))).alias("_back"))
    uses = uses.withColumn("local_date", F.date_add("local_date", F.col("_back")))
    at = lambda t, back: F.max(F.when(F.col("_back") == back, F.col(t)))
    wide = uses.groupBy("local_date").agg(
        at("rate_day", 0).alias("rate_day"), F.max(F.col("_back") == 0).alias("_here"),
        *(at(t, b).alias(f"_{t}_{b}") for t in COUNTS for b in (0, WEEK, RATE_DAYS)),
    )
    part = lambda t, b: F.col(f"_{t}_0") - F.coalesce(F.col(f"_{t}_{b}"), F.lit(0))
    sums = wide.where("_here").select(
        "local_date", "rate_day",
        *(part(t, b).alias(f"{t}_{b}") for t in COUNTS for b in (WEEK, RATE_DAYS)),
    )
    out = sums.select(
        "local_date", "rate_day",
        _percent(f"no_buy_total_{WEEK}", f"allowance_total_{WEEK}").alias("rate_7d"),
        _percent(f"no_buy_total_{RATE_DAYS}", f"allowance_total_{RATE_DAYS}").alias("rate_28d"),
    )
    return out.where(F.col("local_date") >= F.lit(d_from)) if d_from is not None else out
