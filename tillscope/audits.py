"""``ShopAudits``: the dashboard's calls as methods over one set of inputs.

Each method is the per-request form of an audit (one local day, an e-mail
list, an ``as_of`` instant) and returns a lazy DataFrame; the range forms in
``tillscope.operators`` serve scheduled jobs. ``inputs`` provides
``logins``, ``carts``, ``treatment_plans``, ``shop_orders``, ``activity``,
``customers`` and ``contacts`` (e.g. ``tillscope.sources.fixtures.Fixtures``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from tillscope.config import DEFAULT_CONFIG, AuditConfig
from tillscope.functions.timez import date_spine
from tillscope.operators import funnel, intent, live, logins, profiles, purchases, recovery, report


def _d(x) -> dt.date:
    return dt.date.fromisoformat(x) if isinstance(x, str) else x


class ShopAudits:
    def __init__(self, inputs, cfg: AuditConfig = DEFAULT_CONFIG):
        self.inputs = inputs
        self.cfg = cfg
        self.spark = inputs.shop_orders.sparkSession

    # logins view ---------------------------------------------------------
    def patients(self, d, with_allowance: bool = False) -> DataFrame:
        """Login audit of day ``d`` with purchase flags (A1 + A2)."""
        d = _d(d)
        i = self.inputs
        audit = logins.login_audit(i.logins, i.carts, i.treatment_plans, d, d, with_allowance, self.cfg)
        return logins.login_purchase_flags(audit, self.purchases(d))

    def patients_without_orders(self, d) -> DataFrame:
        """The 'no orders' tab (A3): all logins, then no order and allowance > 0."""
        return logins.login_no_orders(self.patients(d))

    # purchases view ------------------------------------------------------
    def purchases(self, d, tab: str = "all") -> DataFrame:
        d = _d(d)
        return purchases.purchase_status_filter(purchases.purchases(self.inputs.shop_orders, d, d, self.cfg), tab)

    def purchase_kpis(self, d) -> DataFrame:
        d = _d(d)
        p = purchases.purchases(self.inputs.shop_orders, d - dt.timedelta(days=1), d, self.cfg)
        return purchases.purchase_kpis(p, date_spine(self.spark, d, d))

    def purchase_history(self, d) -> DataFrame:
        """24 hourly rows: today, yesterday, 7 and 28 days ago."""
        d = _d(d)
        p = purchases.hourly_sales_inputs(self.inputs.shop_orders, d, d, self.cfg)
        return purchases.hourly_sales_history(p, date_spine(self.spark, d, d), self.cfg)

    def purchase_history_cumulative(self, d) -> DataFrame:
        return purchases.hourly_cumulative_sales(self.purchase_history(d))

    def purchase_traffic(self, d) -> DataFrame:
        d = _d(d)
        p = purchases.purchases(self.inputs.shop_orders, d - dt.timedelta(days=1), d, self.cfg)
        return purchases.hourly_traffic(p, date_spine(self.spark, d, d), self.cfg)

    def weekday_comparison(self, as_of_local: dt.datetime, weeks: int = 5) -> DataFrame:
        """Same weekday over the last ``weeks`` weeks up to the hour of ``as_of_local``."""
        d = as_of_local.date()
        p = purchases.purchases(self.inputs.shop_orders, d - dt.timedelta(days=7 * (weeks - 1)), d, self.cfg)
        return purchases.weekday_comparison(p, date_spine(self.spark, d, d), as_of_local.hour, weeks, self.cfg)

    # funnel / live -------------------------------------------------------
    def funnel(self, d) -> DataFrame:
        d = _d(d)
        return funnel.with_funnel_outcome(funnel.login_funnel(self.inputs.logins, self.inputs.activity, d, d, self.cfg))

    def live_visitors(self, as_of_utc: dt.datetime, minutes: int = 5) -> DataFrame:
        return live.live_visitors(self.inputs.activity, as_of_utc, minutes, self.cfg)

    def live_count(self, as_of_utc: dt.datetime, minutes: int = 5) -> DataFrame:
        return live.live_count(self.live_visitors(as_of_utc, minutes))

    # recovery / intent ---------------------------------------------------
    def abandoned_carts(self, d, with_allowance: bool = False) -> DataFrame:
        d = _d(d)
        return recovery.abandoned_carts(self.inputs.carts, self.inputs.logins, d, d, with_allowance, self.cfg)

    def daily_intent_audit(self, d_from, d_to=None) -> DataFrame:
        """Per-day intent rows with the 7/28-day pooled rates (A18 + A20).

        The rates look back 27 days, so the daily rows are computed from then
        on and the asked days kept.
        """
        a = _d(d_from)
        b = _d(d_to) if d_to is not None else a
        return intent.intent_with_rates(self.inputs.logins, self.inputs.shop_orders, a, b, self.cfg)

    def unfulfilled_lookups(self, d) -> DataFrame:
        d = _d(d)
        p = purchases.purchases(self.inputs.shop_orders, d - dt.timedelta(days=intent.LOOKBACK_DAYS), d, self.cfg)
        return intent.unfulfilled_lookups(logins.latest_logins(self.inputs.logins, d, d, False, self.cfg), p)

    # profiles ------------------------------------------------------------
    def _emails(self, emails) -> DataFrame:
        if isinstance(emails, DataFrame):
            return emails.select("email")
        return self.spark.createDataFrame([(e,) for e in emails], "email string")

    def customer(self, emails, n: int = 10) -> DataFrame:
        """Name and up to ``n`` latest orders for each requested e-mail."""
        return profiles.customer_profile(self.inputs.customers, self.inputs.shop_orders, n, self._emails(emails))

    def contact(self, emails, d) -> tuple[DataFrame, DataFrame]:
        """CRM contact with fallbacks (A22) and the day's session replays."""
        e = self._emails(emails)
        return (
            profiles.contact_profile(e, self.inputs.contacts, self.cfg),
            profiles.session_replays_for_day(self.inputs.activity, e, _d(d), self.cfg),
        )

    # presentation --------------------------------------------------------
    @staticmethod
    def search(df: DataFrame, text: str) -> DataFrame:
        return report.audit_search(df, text)

    @staticmethod
    def newest_first(df: DataFrame, view: str) -> DataFrame:
        """A view in the dashboard's order (its default sort key, newest first)."""
        return report.newest_first(df, view)

    @staticmethod
    def sort(df: DataFrame, key: str, ascending: bool = False) -> DataFrame:
        return report.audit_sort(df, key, ascending)

    @staticmethod
    def export(df: DataFrame, view: str, path: str) -> str:
        from tillscope.sources.sinks import write_csv

        return write_csv(report.export_projection(df, view), path)


__all__ = ["ShopAudits"]
