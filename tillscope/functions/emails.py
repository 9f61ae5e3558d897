"""E-mail keys: masking, normalisation and the test-account rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.config import MASK_TOKEN


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mask_email(email: Column | str) -> Column:
    """``a@b`` -> ``a[at]b`` (how login tables store addresses)."""
    return F.replace(_col(email), F.lit("@"), F.lit(MASK_TOKEN))


def unmask_email(email: Column | str) -> Column:
    """``a[at]b`` -> ``a@b`` (every occurrence)."""
    return F.replace(_col(email), F.lit(MASK_TOKEN), F.lit("@"))


def normalize_email(email: Column | str) -> Column:
    """Join key for cross-system e-mail matches: lower, unmask, trim."""
    return F.trim(unmask_email(F.lower(_col(email))))


#: Column of tables that carry their normalised e-mail (``sources.email_layout``).
EMAIL_KEY = "email_key"


def email_key(df: DataFrame) -> Column:
    """The normalised e-mail of ``df``: its column where it has one (a layout by
    it then needs no shuffle), else computed."""
    return F.col(EMAIL_KEY) if EMAIL_KEY in df.columns else normalize_email("email")


def is_test_account(email: Column | str, test_account: str) -> Column:
    """True only for the test account; NULL e-mail gives False (row kept)."""
    return normalize_email(email).eqNullSafe(F.lit(test_account.lower()))
