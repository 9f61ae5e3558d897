"""Column helpers (built-in Spark expressions only; no UDFs)."""

from tillscope.functions.emails import is_test_account, mask_email, normalize_email, unmask_email
from tillscope.functions.labels import (
    display_time,
    furthest_stage,
    funnel_outcome,
    high_non_conversion,
    money_text,
    paid_label,
    shop_filter,
    stage_label,
    status_text,
)
from tillscope.functions.timez import (
    date_spine,
    date_spine_of,
    local_date,
    local_day_filter,
    to_local,
    utc_window_filter,
    where_local_days,
)

__all__ = [
    "date_spine",
    "date_spine_of",
    "display_time",
    "furthest_stage",
    "funnel_outcome",
    "high_non_conversion",
    "is_test_account",
    "local_date",
    "local_day_filter",
    "mask_email",
    "money_text",
    "normalize_email",
    "paid_label",
    "shop_filter",
    "stage_label",
    "status_text",
    "to_local",
    "unmask_email",
    "utc_window_filter",
    "where_local_days",
]
