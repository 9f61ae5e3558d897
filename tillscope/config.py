"""Audit configuration: zone, test account, shop surfaces and link bases.

Hosts and link bases here are neutral placeholders matching the fixture
tables; production values are supplied by the caller.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values (must match the reference's semantics) -------------------
# Payment status that counts as paid, and fulfilment status that counts as done.
PAID_STATUS = "FULLY_CHARGED"
FULFILLED_STATUS = "FULFILLED"
# Funnel events, in ladder order from furthest to nearest, then the
# exception event that only feeds the error count.
STAGE_LADDER = (
    "purchase_completed",
    "payment_success",
    "payment_error",
    "payment_initiated",
    "payment_page_visit",
    "checkout_initiated",
    "cart_added",
)
EXCEPTION_EVENT = "$exception"
FUNNEL_EVENTS = (
    "cart_added",
    "checkout_initiated",
    "payment_page_visit",
    "payment_initiated",
    "payment_success",
    "payment_error",
    "purchase_completed",
    "$exception",
)
# Masked e-mail marker used by the login tables.
MASK_TOKEN = "[at]"
# Display labels of the funnel stages.
STAGE_LABELS = {
    "cart_added": "Cart Added",
    "checkout_initiated": "Checkout",
    "payment_page_visit": "Payment Page",
    "payment_initiated": "Payment Init",
    "payment_error": "Payment Error",
    "payment_success": "Payment Success",
    "purchase_completed": "Purchased",
}
# Non-conversion percentage above which a day is flagged.
HIGH_NON_CONVERSION = 70
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class AuditConfig:
    """Parameters shared by every audit."""

    tz: str = "Australia/Sydney"
    test_account: str = "user7@example.com"
    # Shop surface: (host, path prefix or None). A None prefix accepts any path.
    shop_rules: tuple[tuple[str, str | None], ...] = field(
        default=(
            ("care.example.com", "/patient"),
            ("shop.example.com", None),
            ("pay.example.com", None),
        )
    )
    # Event-store zone used for the funnel's activity day (survey R8).
    activity_tz: str = "UTC"
    replay_base: str = "https://replay.example.com/replay/"
    crm_base: str = "https://crm.example.com/contacts/"
    default_currency: str = "AUD"


DEFAULT_CONFIG = AuditConfig()
