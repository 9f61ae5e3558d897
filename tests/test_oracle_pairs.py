"""Every registered query equals its DuckDB oracle (whole tables).

Runs at sf0.001 by default; set ORACLE_SF_DIR (e.g. /root/testdata/sf0.1) for
a larger scale factor.
"""

import os

import pytest

import __spark_entry__ as E
from tests.conftest import SF001
from tests.oracle import compare

SQL = E.oracle_sql()
QS = {n: f for n, f in E.queries().items() if n in SQL}


def test_every_audit_has_an_oracle():
    from tillscope.plans import QUERIES
    from tillscope.streaming.catalog import STREAM_QUERIES

    assert set(QUERIES) | set(STREAM_QUERIES) <= set(SQL) <= set(E.queries())


SF_DIR = os.environ.get("ORACLE_SF_DIR", SF001)


@pytest.mark.parametrize("name", sorted(QS))
def test_oracle_pair(spark, name):
    compare(spark, SF_DIR, name, QS[name], SQL[name])


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 150  # all local days of January 2024 at sf0.001
    assert df.columns == ["local_date", "email", "allowance", "login_time", "last_order_at", "order_count", "tp_date"]
