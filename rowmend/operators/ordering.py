"""Ordered work on tables too large for one window partition.

The reference order is (t, row_id).  A group (or the whole table) with more rows than one task should hold is cut into
consecutive buckets of that order.  Bucket borders come from a sample, which only affects balance: any borders give the
same results, because values that must cross a border travel in a small table with one row per bucket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keyed import join_groups

BUCKET = "__bucket"
WHOLE = -1  # bucket number of rows in groups that were not split
MAX_WINDOW_ROWS = 2_000_000  # a window task should not hold more rows, while the bucket table stays small
MIN_WINDOW_ROWS = 200_000  # below this, cutting costs more than one sort
MAX_BUCKETS = 50_000  # bounds the border sample on the driver and the broadcast border table
_SAMPLES_PER_BUCKET = 16


def window_rows(n: int, parallelism: int) -> int:
    """Rows per window task: several tasks per core on a small table, a fixed size on a large one."""
    return max(MIN_WINDOW_ROWS, min(MAX_WINDOW_ROWS, n // (3 * parallelism)))


def spread_small(df: DataFrame, n: int, row_id: str) -> DataFrame:
    """Rows of a small table over all cores: its few window partitions would leave most of them idle in later passes."""
    parallelism = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parallelism, row_id) if n < window_rows(n, parallelism) * parallelism else df


def _borders(keys: DataFrame, order: Sequence[str], group_cols: Sequence[str], n: int, max_rows: int,
             ) -> dict[tuple, list[tuple]]:
    """Sampled borders per large group; about n / max_rows in total."""
    buckets = min(math.ceil(n / max_rows) + 1, MAX_BUCKETS)
    per_bucket = n / buckets
    fraction = min(1.0, 1.2 * _SAMPLES_PER_BUCKET / per_bucket)
    sample: dict[tuple, list[tuple]] = {}
    for row in keys.select(*group_cols, *order).dropna(subset=list(order)).sample(fraction, seed=17).collect():
        sample.setdefault(tuple(row[:len(group_cols)]), []).append(tuple(row[len(group_cols):]))
    step = max(1, round(fraction * per_bucket))
    return {k: found for k, rows in sample.items() if (found := sorted(set(sorted(rows)[step::step])))}


def _join_bucket(df: DataFrame, borders: dict[tuple, list[tuple]], order: Sequence[str],
                 group_cols: Sequence[str]) -> DataFrame:
    """Number of borders below each row's key, in O(log borders) per row; WHOLE for rows of groups without borders.

    The time axis of a group is cut into as many equal cells as it has borders; a broadcast table gives, per cell, how many
    borders lie in earlier cells and which lie in this one, and a binary search in that short array does the rest.  Both
    broadcast tables have at most MAX_BUCKETS rows, whatever the size of the data.
    """
    spark = df.sparkSession
    t = order[0]
    axes, rows, longest = [], [], 1
    for key, found in borders.items():
        low, cells = float(found[0][0]), len(found)
        width = (float(found[-1][0]) - low) / cells or 1.0
        inside: dict[int, list[tuple]] = {}
        for border in found:
            cell = int(min(max(math.floor((float(border[0]) - low) / width), 0), cells - 1))
            inside.setdefault(cell, []).append(border)
        longest = max(longest, *(len(v) for v in inside.values()))
        axes.append((*key, low, width, cells))
        base = 0
        for cell in range(cells):
            rows.append((*key, cell, base, inside.get(cell, [])))
            base += len(inside.get(cell, []))
    group_fields = [df.schema[c] for c in group_cols]
    key_type = T.StructType([T.StructField(c, df.schema[c].dataType) for c in order])
    table = spark.createDataFrame(rows, T.StructType([
        *group_fields, T.StructField("__cell", T.LongType()), T.StructField("__base", T.IntegerType()),
        T.StructField("__borders", T.ArrayType(key_type))]))
    if group_cols:
        axis = spark.createDataFrame(axes, T.StructType([
            *group_fields, T.StructField("__low", T.DoubleType()), T.StructField("__width", T.DoubleType()),
            T.StructField("__cells", T.LongType())]))
        df = join_groups(df, F.broadcast(axis), group_cols)
    else:
        low, width, cells = axes[0]
        df = df.withColumns({"__low": F.lit(low), "__width": F.lit(width), "__cells": F.lit(cells).cast("bigint")})
    cell = F.floor((F.col(t).cast("double") - F.col("__low")) / F.col("__width"))
    cell = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("__cells") - 1, F.coalesce(cell, F.lit(0).cast("bigint"))))  # no time: first
    df = df.withColumn("__cell", F.when(F.col("__cells").isNotNull(), cell))
    steps = F.array(*[F.lit(2 ** i) for i in reversed(range(longest.bit_length()))])
    key = F.struct(*[F.col(c) for c in order])
    found = F.aggregate(steps, F.lit(0), lambda pos, step: F.when(
        F.get("__borders", pos + step - 1) < key, pos + step).otherwise(pos))
    joined = join_groups(df, F.broadcast(table), [*group_cols, "__cell"])
    return (joined.withColumn(BUCKET, F.coalesce(F.col("__base") + found, F.lit(WHOLE)))
            .drop("__cell", "__base", "__borders", "__low", "__width", "__cells"))


def with_buckets(df: DataFrame, order: Sequence[str], group_cols: Sequence[str] = (),
                 max_rows: int | None = None) -> tuple[DataFrame, bool]:
    """Add the bucket number; the flag says whether any group was split.  `order` starts with a numeric time."""
    columns = df.columns
    keys = df.select(*group_cols, *order)
    parallelism = df.sparkSession.sparkContext.defaultParallelism
    if group_cols:
        counts = keys.groupBy(*group_cols).count()
        if max_rows is None:
            max_rows = window_rows(counts.agg(F.sum("count")).first()[0] or 0, parallelism)
        hot = counts.filter(F.col("count") > max_rows).collect()  # at most rows / max_rows entries
        n = sum(r["count"] for r in hot)
        if hot:
            table = df.sparkSession.createDataFrame([tuple(r[c] for c in group_cols) for r in hot],
                                                    T.StructType([df.schema[c] for c in group_cols]))
            keys = join_groups(keys, F.broadcast(table), group_cols, "left_semi")
    else:
        n = keys.count()
        max_rows = max_rows or window_rows(n, parallelism)
        n = n if n > max_rows else 0
    borders = _borders(keys, order, group_cols, n, max_rows) if n else {}
    if not borders:
        return df.withColumn(BUCKET, F.lit(WHOLE)), False
    return _join_bucket(df, borders, order, group_cols).select(*columns, BUCKET), True


def bucket_ends(df: DataFrame, variables: Sequence[str], order: Sequence[str], group_cols: Sequence[str],
                sides: Sequence[str] = ("last", "first"), what: str = "value") -> DataFrame:
    """One row per bucket with `t` and value (or row id) of the last and first observed cell of every variable.

    Two scans with hash aggregates over plain numbers: first the border times, then the cell with the largest (smallest) row id
    among those at that time.  A single max_by over (t, row_id) structs would sort the whole table.
    """
    t, row_id = order
    keys = [*group_cols, BUCKET]
    df = df.filter(F.col(BUCKET) != WHOLE)  # leaves at most MAX_BUCKETS buckets, so their ends may be broadcast
    pick = {"last": (F.max, F.max_by), "first": (F.min, F.min_by)}
    times = df.groupBy(*keys).agg(*[
        pick[s][0](F.when(F.col(v).isNotNull(), F.col(t))).alias(f"{s}_t_{v}") for s in sides for v in variables])
    cells = []
    for s in sides:
        for v in variables:
            rank = F.when(F.col(v).isNotNull() & (F.col(t) == F.col(f"{s}_t_{v}")), F.col(row_id))
            cells.append((pick[s][1](F.col(v), rank) if what == "value" else pick[s][0](rank)).alias(f"{s}_{v}"))
    picked = join_groups(df, F.broadcast(times), keys, "inner").groupBy(*keys).agg(*cells)
    return join_groups(picked, F.broadcast(times), keys, "inner")


def carry_in(ends: DataFrame, variables: Sequence[str], group_cols: Sequence[str],
             sides: Sequence[str] = ("last", "first")) -> DataFrame:
    """Per bucket, the last observed cell of earlier buckets (`before_<v>`, `before_t_<v>`) and the first of later ones
    (`after_<v>`, `after_t_<v>`)."""
    windows = {
        "last": Window.partitionBy(*group_cols).orderBy(F.col(BUCKET)).rowsBetween(Window.unboundedPreceding, -1),
        "first": Window.partitionBy(*group_cols).orderBy(F.col(BUCKET).desc()).rowsBetween(Window.unboundedPreceding, -1)}
    names = {"last": "before", "first": "after"}
    return ends.select(*group_cols, BUCKET, *[
        F.last(f"{s}_{part}{v}", ignorenulls=True).over(windows[s]).alias(f"{names[s]}_{part}{v}")
        for s in sides for part in ("", "t_") for v in variables])


def with_position(df: DataFrame, order: Sequence[str] = ("t", "row_id"), group_cols: Sequence[str] = (),
                  name: str = "pos", max_rows: int | None = None) -> DataFrame:
    """Add the 0-based rank of each row in its group without sorting a large group in one task."""
    df, split = with_buckets(df, order, group_cols, max_rows)
    within = Window.partitionBy(*group_cols, BUCKET).orderBy(*order)
    df = df.withColumn(name, (F.row_number().over(within) - 1).cast("bigint"))
    if split:
        counts = df.filter(F.col(BUCKET) != WHOLE).groupBy(*group_cols, BUCKET).agg(F.count(F.lit(1)).alias("__n"))
        earlier = Window.partitionBy(*group_cols).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select(*group_cols, BUCKET, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
        df = (join_groups(df, F.broadcast(offsets), [*group_cols, BUCKET])
              .withColumn(name, F.col(name) + F.coalesce(F.col("__offset"), F.lit(0))).drop("__offset"))
    return df.drop(BUCKET)
