"""Label, ladder and surface predicates as built-in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillscope.config import HIGH_NON_CONVERSION, PAID_STATUS, STAGE_LABELS, STAGE_LADDER, AuditConfig


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def furthest_stage(prefix: str = "") -> Column:
    """Furthest funnel stage from the seven boolean stage columns, else NULL."""
    expr = None
    for stage in STAGE_LADDER:
        cond = F.coalesce(F.col(prefix + stage), F.lit(False))
        expr = F.when(cond, F.lit(stage)) if expr is None else expr.when(cond, F.lit(stage))
    return expr.otherwise(F.lit(None).cast("string"))


def funnel_outcome() -> Column:
    """success if completed or payment success; else error if payment error; else none."""
    return (
        F.when(F.col("purchase_completed") | F.col("payment_success"), F.lit("success"))
        .when(F.col("payment_error"), F.lit("error"))
        .otherwise(F.lit("none"))
    )


def paid_label(payment_status: Column | str = "payment_status") -> Column:
    return F.when(_col(payment_status).eqNullSafe(F.lit(PAID_STATUS)), "PAID").otherwise("UNPAID")


def status_text(status: Column | str = "status") -> Column:
    """Status for display: underscores become spaces."""
    return F.replace(_col(status), F.lit("_"), F.lit(" "))


def money_text(amount: Column | str, currency: Column | str = "currency") -> Column:
    """``AUD $12.30`` style text with two decimals (no grouping separators)."""
    return F.format_string("%s $%.2f", _col(currency), _col(amount).cast("double"))


def stage_label(stage: Column | str = "furthest_stage") -> Column:
    """Display label of a funnel stage; 'none' when there is no stage."""
    expr = None
    for key, label in STAGE_LABELS.items():
        cond = _col(stage) == F.lit(key)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit("none"))


def display_time(ts_utc: Column | str, tz: str) -> Column:
    """en-AU short display of a UTC instant in ``tz`` (``29 Jan, 14:30:00``),
    'N/A' when missing."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), _col(ts_utc))
    return F.coalesce(F.date_format(local, "dd MMM, HH:mm:ss"), F.lit("N/A"))


def high_non_conversion(pct: Column | str = "non_conversion_percent", threshold: int = HIGH_NON_CONVERSION) -> Column:
    return _col(pct) > F.lit(threshold)


def shop_filter(
    cfg: AuditConfig,
    host: Column | str = "host",
    pathname: Column | str = "pathname",
    hosts_override: tuple[str, ...] | None = None,
) -> Column:
    """Shop-surface predicate.

    Default: any configured (host, path prefix) rule matches. An override is a
    plain host list with no path check.
    """
    h, p = _col(host), _col(pathname)
    if hosts_override:
        return h.isin(*[x.strip() for x in hosts_override])
    cond = F.lit(False)
    for rule_host, prefix in cfg.shop_rules:
        term = h == F.lit(rule_host)
        if prefix is not None:
            term = term & p.startswith(prefix)
        cond = cond | term
    return cond
