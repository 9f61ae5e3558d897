"""tillscope: Spark-native audit datasets for an online store.

Every audit is a lazy DataFrame plan over landed tables; nothing is
collected to the driver. Entry points: ``tillscope.operators`` (range
audits), ``tillscope.audits.ShopAudits`` (per-request calls),
``tillscope.plans.audit_job`` (materialise all audits) and
``tillscope.streaming`` (live forms). See README.md for the module map.
"""

from tillscope.config import DEFAULT_CONFIG, AuditConfig

__version__ = "0.1.0"


def __getattr__(name):
    # Lazy: importing the package must not require a Spark session.
    if name == "ShopAudits":
        from tillscope.audits import ShopAudits

        return ShopAudits
    raise AttributeError(name)


__all__ = ["AuditConfig", "DEFAULT_CONFIG", "ShopAudits", "__version__"]
