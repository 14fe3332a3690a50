"""The two shapes every matrix operator takes: a distributed sum of small arrays, and a row-local map.

Rows stay on the executors.  `sum_stats` turns each Arrow batch into numpy matrices, adds one small vector per
group inside the task, and lets Spark's hash aggregate add the partial vectors; the driver only receives
groups x vector-length numbers.  `row_map` is an Arrow scalar function, so columns it does not need never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Most numbers a driver-side step may receive or send per pass (8 bytes each).
MAX_DRIVER_NUMBERS = 50_000_000


def _floats(array) -> np.ndarray:
    return np.asarray(array.to_numpy(zero_copy_only=False), dtype=float)


def group_rows(keys: list[pa.Array], n: int) -> list[tuple[tuple, np.ndarray | slice]]:
    """[(key tuple, row positions)] of one batch."""
    if not keys:
        return [((), slice(None))]
    frame = pd.DataFrame({i: k.to_pandas() for i, k in enumerate(keys)})
    codes = frame.groupby(list(frame.columns), sort=False, dropna=False).ngroup().to_numpy()
    order = np.argsort(codes, kind="stable")
    cuts = np.flatnonzero(np.diff(codes[order])) + 1
    return [(tuple(k[int(rows[0])].as_py() for k in keys), rows) for rows in np.split(order, cuts) if n]


def check_driver_size(groups: int, width: int) -> None:
    if groups * width > MAX_DRIVER_NUMBERS:
        raise ValueError(f"{groups} groups x {width} statistics are too many for one pass; "
                         "run the groups in waves (see rowmend.plans.waves)")


def _partial_schema(df: DataFrame, group_cols: Sequence[str]) -> T.StructType:
    return T.StructType([df.schema[c] for c in group_cols]
                        + [T.StructField("pos", T.IntegerType()), T.StructField("val", T.DoubleType())])


def _partial_batch(key: tuple, vector: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    width = len(vector)
    columns = [pa.array([k] * width, type=schema.field(i).type) for i, k in enumerate(key)]
    columns += [pa.array(np.arange(width, dtype=np.int32)), pa.array(np.asarray(vector, dtype=float))]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _collect_sums(partial: DataFrame, group_cols: Sequence[str]) -> dict[tuple, np.ndarray]:
    table = partial.groupBy(*group_cols, "pos").agg(F.sum("val").alias("val")).toArrow()
    pos = table.column("pos").to_numpy()
    val = table.column("val").to_numpy()
    keys = [table.column(c).combine_chunks() for c in group_cols]
    out = {}
    if table.num_rows:
        for key, rows in group_rows(keys, table.num_rows):
            vector = np.empty(len(pos[rows]))
            vector[pos[rows]] = val[rows]
            out[key] = vector
    return out


def sum_stats(df: DataFrame, blocks: Mapping[str, Sequence[str]], kernel: Callable[..., np.ndarray],
              group_cols: Sequence[str] = ()) -> dict[tuple, np.ndarray]:
    """Sum of kernel(key, **matrices) over all rows, per group.

    `blocks` maps an argument name of the kernel to the columns that form that matrix (NULL arrives as NaN).
    """
    names = list(dict.fromkeys(c for cols in blocks.values() for c in cols))
    schema = _partial_schema(df, group_cols)
    arrow = to_arrow_schema(schema)
    blocks = {k: list(v) for k, v in blocks.items()}
    n_keys = len(group_cols)

    def partials(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {c: _floats(batch.column(n_keys + i)) for i, c in enumerate(names)}
            matrices = {k: np.column_stack([column[c] for c in cols]) for k, cols in blocks.items()}
            for key, rows in group_rows([batch.column(i) for i in range(n_keys)], batch.num_rows):
                vector = kernel(key, **{k: m[rows] for k, m in matrices.items()})
                sums[key] = sums[key] + vector if key in sums else vector
        for key, vector in sums.items():
            yield _partial_batch(key, vector, arrow)

    partial = df.select(*group_cols, *names).mapInArrow(partials, schema)
    return _collect_sums(partial, group_cols)


def row_map(df: DataFrame, blocks: Mapping[str, Sequence[str]], fn: Callable[..., np.ndarray],
            out: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """Append DOUBLE columns `out` = fn(key, **matrices), a matrix with one column per name; NaN becomes NULL."""
    names = list(dict.fromkeys(c for cols in blocks.values() for c in cols))
    blocks = {k: list(v) for k, v in blocks.items()}
    out = list(out)
    n_keys = len(group_cols)
    result = T.StructType([T.StructField(c, T.DoubleType()) for c in out])

    @F.arrow_udf(result)
    def mapped(*arrays: pa.Array) -> pa.Array:
        n = len(arrays[0])
        column = {c: _floats(arrays[n_keys + i]) for i, c in enumerate(names)}
        matrices = {k: np.column_stack([column[c] for c in cols]) for k, cols in blocks.items()}
        values = np.full((n, len(out)), np.nan)
        for key, rows in group_rows(list(arrays[:n_keys]), n):
            values[rows] = fn(key, **{k: m[rows] for k, m in matrices.items()})
        return pa.StructArray.from_arrays(
            [pa.array(values[:, i], from_pandas=True) for i in range(len(out))], names=out)

    kept = [c for c in df.columns if c not in out]
    packed = df.withColumn("__mapped", mapped(*group_cols, *names))
    return packed.select(*kept, *[F.col(f"__mapped.{c}").alias(c) for c in out])
