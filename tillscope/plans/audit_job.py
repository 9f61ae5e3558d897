"""One job that materialises the date-based audits for a local-day range.

The dashboard asks one endpoint per view and per day; here a scheduled job
writes each audit dataset once, partitioned by ``local_date``, into the
shared folder (or a given root). A run replaces the days it writes and leaves
all others. The purchases and latest logins that most views share are written
first, to a folder of the run, and read back, which cuts their lineage: a lost
executor costs only its own tasks.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.config import DEFAULT_CONFIG, AuditConfig
from tillscope.functions.timez import date_spine
from tillscope.operators import funnel, intent, logins, profiles, purchases, recovery
from tillscope.session import scratch_path
from tillscope.sources.sinks import write_parquet

# How far back the hourly comparisons reach (D-28).
LOOKBACK_DAYS = 28


def _d(x) -> dt.date:
    return dt.date.fromisoformat(x) if isinstance(x, str) else x


def run_audits(
    spark: SparkSession,
    inputs,
    d_from,
    d_to,
    out_root: str | None = None,
    cfg: AuditConfig = DEFAULT_CONFIG,
    weekday_cutoff_hour: int = 23,
) -> dict[str, str]:
    """Write the audits of local days [d_from, d_to]; returns name -> path.

    ``inputs`` has ``logins``, ``carts``, ``treatment_plans``, ``shop_orders``
    and ``activity`` DataFrames (e.g. ``Fixtures``).
    """
    a, b = _d(d_from), _d(d_to)
    root = out_root or scratch_path(spark, f"audits-{a}-{b}")
    spine = date_spine(spark, a, b)
    in_range = F.col("local_date").between(F.lit(a), F.lit(b))

    # Shared prep, written once to a folder of this run: purchases as far back
    # as any view looks (the hourly history 28 days, the intent rates 34).
    first = min(a - dt.timedelta(days=LOOKBACK_DAYS), intent.intent_orders_from(a))
    prep = write_parquet(
        purchases.purchases(inputs.shop_orders, first, b, cfg),
        scratch_path(spark, "audit-purchases"),
        partition_by="local_date",
    )
    p_all = spark.read.parquet(prep)
    p = p_all.where(in_range)

    audit = logins.login_audit(inputs.logins, inputs.carts, inputs.treatment_plans, a, b, False, cfg)
    f = funnel.login_funnel(inputs.logins, inputs.activity, a, b, cfg)
    latest = write_parquet(logins.latest_logins(inputs.logins, a, b, False, cfg), scratch_path(spark, "audit-logins"))
    latest = spark.read.parquet(latest)
    daily = intent.intent_with_rates(inputs.logins, None, a, b, cfg, p_all)
    views: dict[str, DataFrame] = {
        "login_audit": logins.login_purchase_flags(audit, p),
        "login_audit_allowance": logins.login_audit(
            inputs.logins, inputs.carts, inputs.treatment_plans, a, b, True, cfg
        ),
        "purchases": p,
        "purchase_kpis": purchases.purchase_kpis(p_all.where(F.col("local_date") >= F.lit(a - dt.timedelta(days=1))), spine),
        "hourly_sales_history": purchases.hourly_sales_history(p_all, spine, cfg),
        "hourly_traffic": purchases.hourly_traffic(p_all, spine, cfg),
        "weekday_comparison": purchases.weekday_comparison(p_all, spine, weekday_cutoff_hour, 5, cfg).withColumnRenamed(
            "local_date", "compared_date"
        ).withColumnRenamed("ref_date", "local_date"),
        "login_funnel": f,
        "abandoned_carts": recovery.abandoned_carts(inputs.carts, inputs.logins, a, b, False, cfg),
        "daily_intent_audit": daily,
        "unfulfilled_lookups": intent.unfulfilled_lookups(latest, p_all),
        "login_no_orders": logins.login_no_orders(audit),
        "purchases_unpaid": purchases.purchase_status_filter(p, "unpaid"),
        "hourly_cumulative_sales": purchases.hourly_cumulative_sales(purchases.hourly_sales_history(p_all, spine, cfg)),
        "funnel_stage_counts": funnel.funnel_stage_counts(f),
        "funnel_stage_breakdown": funnel.funnel_stage_breakdown(f),
        "session_replays": profiles.session_replays(inputs.activity, latest.select("local_date", "email"), cfg),
    }
    out = {}
    for name, df in views.items():
        out[name] = write_parquet(df.where(in_range), f"{root}/{name}", partition_by="local_date")
    return out


def main(argv: list[str] | None = None) -> None:
    """``python -m tillscope.plans.audit_job SF_DIR FROM TO [OUT_ROOT]``."""
    import argparse
    import json

    from tillscope.session import local_session
    from tillscope.sources.fixtures import Fixtures

    ap = argparse.ArgumentParser(description="Materialise the date-based audits for a local-day range.")
    ap.add_argument("sf_dir")
    ap.add_argument("d_from")
    ap.add_argument("d_to")
    ap.add_argument("out_root", nargs="?")
    args = ap.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    paths = run_audits(spark, Fixtures(spark, args.sf_dir), args.d_from, args.d_to, args.out_root)
    print(json.dumps(paths, indent=1))


if __name__ == "__main__":
    main()
