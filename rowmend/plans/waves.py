"""Many groups, a few at a time: keeps what the driver and the closures hold bounded without leaving any group out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_waves(df: DataFrame, group_cols: Sequence[str], waves: int, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Union of run(part) over parts that split the groups by a hash of their key."""
    wave = F.pmod(F.xxhash64(*group_cols), F.lit(waves))
    parts = [run(df.filter(wave == w)) for w in range(waves)]
    return reduce(DataFrame.unionByName, parts)
