"""Registered queries and the SQL each of them must agree with."""

from . import iterated, oracles
from .queries import queries


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql() | iterated.oracle_sql()


__all__ = ["oracle_sql", "queries"]
