"""Registered queries over the driver's tables and the SQL that gives the same rows."""

from .plans.driver_queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
