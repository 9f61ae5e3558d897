"""Registered audit plans (Spark) and their DuckDB oracle SQL."""

from tillscope.plans.catalog import FLAGSHIP, QUERIES
from tillscope.plans.oracle import ORACLE_SQL

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
