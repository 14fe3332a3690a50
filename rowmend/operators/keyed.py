"""Equi-joins by group in which a null group is a group like any other."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

JOIN_ROWS = 1_000_000  # rows that one task of a join should sort


def spread_for_join(tables: Sequence[DataFrame], keys: Sequence[str]) -> list[DataFrame]:
    """The tables dealt by key to as many tasks as their rows need; small ones, which the session's number of partitions suits, stay."""
    spark = tables[0].sparkSession
    parts = math.ceil(sum(t.count() for t in tables) / JOIN_ROWS)
    if parts <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return list(tables)
    return [t.repartition(parts, *keys) for t in tables]


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """`left` joined with the other columns of `right` on equal keys, nulls being equal to nulls."""
    renamed = right.select(*[F.col(c).alias(f"__key_{c}") for c in keys], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__key_{c}")) for c in keys])
    return left.join(renamed, same, how).drop(*[f"__key_{c}" for c in keys])
