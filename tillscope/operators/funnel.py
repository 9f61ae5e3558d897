"""Login funnel: A15 session rollup, A14 ladder, A11 funnel, A12/A13 summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.config import DEFAULT_CONFIG, EXCEPTION_EVENT, FUNNEL_EVENTS, STAGE_LADDER, AuditConfig
from tillscope.functions.emails import normalize_email
from tillscope.functions.labels import funnel_outcome, furthest_stage, shop_filter
from tillscope.functions.membership import key_bitmap, may_contain
from tillscope.functions.timez import local_date, where_local_days
from tillscope.operators.dedupe import latest_per
from tillscope.operators.logins import latest_logins

STAGES = tuple(reversed(STAGE_LADDER))  # nearest -> furthest, for column order


def session_stage_rollup(
    activity: DataFrame,
    login_keys: DataFrame | None,
    d_from=None,
    d_to=None,
    cfg: AuditConfig = DEFAULT_CONFIG,
    hosts_override: tuple[str, ...] | None = None,
) -> DataFrame:
    """Per (activity day, e-mail key, session) last time of each stage.

    ``login_keys`` (act_date, email_key) restricts the e-mails per day (the
    reference's ``email IN (...)`` list); None keeps all. One pass of
    conditional aggregates: ``max(ts) FILTER (event = s)`` for the seven
    stages, error/exception counts and last activity. The aggregate runs
    before the semi-join: its map-side partial step collapses each session's
    events (a hot e-mail included) before anything is shuffled, so only
    session rows reach the join. Over a day range, a bitmap of the logins
    (``functions.membership``) drops other visitors' events before that.
    """
    a = where_local_days(activity, "ts", d_from, d_to, cfg.activity_tz).where(
        F.col("event").isin(*FUNNEL_EVENTS) & shop_filter(cfg, hosts_override=hosts_override) & F.col("email").isNotNull()
    ).select(
        local_date("ts", cfg.activity_tz).alias("act_date"),
        normalize_email("email").alias("email_key"),
        "session_id",
        "event",
        "ts",
    )
    if login_keys is not None and (d_from is not None or d_to is not None):
        # A day range has few logins beside the log's visitors: theirs alone go on.
        a = a.where(may_contain(key_bitmap(login_keys, "act_date", "email_key"), F.col("act_date"), F.col("email_key")))
    aggs = [F.max(F.when(F.col("event") == s, F.col("ts"))).alias(f"t_{s}") for s in STAGES]
    aggs += [
        F.count_if(F.col("event") == "payment_error").alias("payment_error_count"),
        F.count_if(F.col("event") == EXCEPTION_EVENT).alias("exception_count"),
        F.max("ts").alias("last_activity"),
    ]
    rolled = a.groupBy("act_date", "email_key", "session_id").agg(*aggs)
    if login_keys is None:
        return rolled
    return rolled.join(login_keys.select("act_date", "email_key").distinct(), ["act_date", "email_key"], "left_semi")


def login_funnel(
    logins: DataFrame,
    activity: DataFrame,
    d_from=None,
    d_to=None,
    cfg: AuditConfig = DEFAULT_CONFIG,
    hosts_override: tuple[str, ...] | None = None,
) -> DataFrame:
    """Latest login per e-mail and local day, joined to that e-mail's
    latest session on the same day (activity day in ``cfg.activity_tz``).

    ``login_time`` is the raw UTC login instant, as the reference returns it.
    """
    lg = latest_logins(logins, d_from, d_to, False, cfg).withColumn("email_key", normalize_email("email"))
    keys = lg.select(F.col("local_date").alias("act_date"), "email_key")
    rollup = session_stage_rollup(activity, keys, d_from, d_to, cfg, hosts_override)
    value_cols = [c for c in rollup.columns if c not in ("act_date", "email_key")]
    best = latest_per(rollup, ["act_date", "email_key"], ["last_activity", "session_id"], value_cols)
    best = best.withColumnRenamed("act_date", "local_date")
    j = lg.join(best, ["local_date", "email_key"], "left")
    flags = [F.col(f"t_{s}").isNotNull().alias(s) for s in STAGES]
    errors = F.coalesce(F.col("payment_error_count") + F.col("exception_count"), F.lit(0).cast("bigint"))
    sess = F.when(F.col("session_id") != "", F.col("session_id"))
    staged = j.select(
        "local_date",
        "email",
        F.col("created_at").alias("login_time"),
        sess.alias("session_id"),
        *flags,
        (errors > 0).alias("has_error"),
        errors.alias("error_count"),
        F.concat(F.lit(cfg.replay_base), sess).alias("replay_url"),
        F.coalesce(F.col("last_activity"), F.col("created_at")).alias("last_activity"),
    )
    return staged.select(
        "local_date",
        "email",
        "login_time",
        "session_id",
        furthest_stage().alias("furthest_stage"),
        *STAGES,
        "has_error",
        "error_count",
        "replay_url",
        "last_activity",
    )


def funnel_stage_counts(funnel: DataFrame) -> DataFrame:
    """Per local day, logins reaching cart / checkout / purchase (cards)."""
    return funnel.groupBy("local_date").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if("cart_added").alias("cart_added"),
        F.count_if("checkout_initiated").alias("checkout_initiated"),
        F.count_if("purchase_completed").alias("purchase_completed"),
    )


def funnel_stage_breakdown(funnel: DataFrame) -> DataFrame:
    """A12 (per stage): records per furthest stage, 'none' for no session."""
    return funnel.groupBy("local_date", F.coalesce("furthest_stage", F.lit("none")).alias("furthest_stage")).agg(
        F.count(F.lit(1)).alias("records")
    )


def with_funnel_outcome(funnel: DataFrame) -> DataFrame:
    """Add success / error / none outcome."""
    return funnel.withColumn("outcome", funnel_outcome())
