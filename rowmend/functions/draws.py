"""Portable uniform draws: the same number in Spark SQL, other SQL engines and plain Python.

A draw depends only on its key (seed, row, variable ...), so it survives repartitioning, retries and lost
executors; `rand()` does none of that.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = 4294967296.0  # 2^32


def _as_col(part) -> Column:
    return part if isinstance(part, Column) else F.lit(str(part))


SLOTS = 4  # independent draws in one digest


def uniform(*key, slot: int = 0) -> Column:
    """Uniform in [0, 1) from md5('k1|k2|...'); Columns and plain values may be mixed.

    `slot` picks one of four independent draws of the same digest, which Spark then computes once.
    """
    text = F.concat_ws("|", *[_as_col(k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1 + 8 * slot, 8), 16, 10).cast("bigint") / F.lit(_SCALE)


def uniform_value(*key) -> float:
    """The same draw for driver-side choices such as which sensors to corrupt."""
    text = "|".join(str(k) for k in key)
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / _SCALE
