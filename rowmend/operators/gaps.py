"""Temporary imputation of gaps in ordered series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keyed import join_groups
from .ordering import BUCKET, bucket_ends, carry_in, with_buckets
from .scaling import attach_stats

METHODS = ("mean", "interpolation", "last_observed")
ORDER = ("t", "row_id")


def with_neighbours(df: DataFrame, variables: Sequence[str], order: Sequence[str] = ORDER,
                    group_cols: Sequence[str] = (), max_rows: int | None = None,
                    split: bool | None = None) -> DataFrame:
    """Add value and time of the nearest observed cell at or before (`__prev_<v>`, `__prev_t_<v>`) and at or after
    (`__next_<v>`, `__next_t_<v>`) each row.

    A table that already carries bucket numbers is used as it is; `split` then says whether any group has several.

    The look-ahead is a second running window in descending order; a frame ending at UNBOUNDED FOLLOWING would rescan
    the partition for every row.
    """
    t = order[0]
    own = split is None
    if own:
        df, split = with_buckets(df, order, group_cols, max_rows)
    keys = [*group_cols, BUCKET]
    up = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    down = (Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
            .rowsBetween(Window.unboundedPreceding, 0))
    out = df
    for side, window in (("prev", up), ("next", down)):
        out = out.withColumns(
            {f"__{side}_{v}": F.last(v, ignorenulls=True).over(window) for v in variables}
            | {f"__{side}_t_{v}": F.last(F.when(F.col(v).isNotNull(), F.col(t)), ignorenulls=True).over(window)
               for v in variables})
    if split:
        carried = carry_in(bucket_ends(df, variables, order, group_cols), variables, group_cols)
        out = join_groups(out, F.broadcast(carried), keys)
        borders = (("prev", "before"), ("next", "after"))
        out = out.withColumns({
            f"__{side}_{part}{v}": F.coalesce(F.col(f"__{side}_{part}{v}"), F.col(f"{border}_{part}{v}"))
            for side, border in borders for part in ("", "t_") for v in variables})
        out = out.drop(*[f"{border}_{part}{v}" for _, border in borders for part in ("", "t_") for v in variables])
    return out.drop(BUCKET) if own else out


def _interpolated(v: str, t: str) -> Column:
    x0, x1 = F.col(f"__prev_{v}"), F.col(f"__next_{v}")
    t0, t1 = F.col(f"__prev_t_{v}"), F.col(f"__next_t_{v}")
    line = F.when(t1 == t0, x0).otherwise(
        x0 + (x1 - x0) / F.nullif((t1 - t0).cast("double"), F.lit(0.0)) * (F.col(t) - t0))
    return F.coalesce(F.col(v), line, x0, x1)


def _fill(df, variables, order, group_cols, max_rows, rule, split=None) -> DataFrame:
    filled = with_neighbours(df, variables, order, group_cols, max_rows, split)
    filled = filled.withColumns({v: rule(v) for v in variables})
    return filled.select(*df.columns)


def impute_interpolate(df: DataFrame, variables: Sequence[str], order: Sequence[str] = ORDER,
                       group_cols: Sequence[str] = (), max_rows: int | None = None,
                       split: bool | None = None) -> DataFrame:
    """Interior gaps: linear in time; leading gaps: first observed; trailing gaps: last observed value.

    Between two cells with equal time the earlier value is taken; a variable without any value stays NULL.
    """
    return _fill(df, variables, order, group_cols, max_rows, lambda v: _interpolated(v, order[0]), split)


def impute_locf(df: DataFrame, variables: Sequence[str], order: Sequence[str] = ORDER,
                group_cols: Sequence[str] = (), max_rows: int | None = None,
                split: bool | None = None) -> DataFrame:
    """Last observed value carried forward; a leading gap takes the first observed value."""
    return _fill(df, variables, order, group_cols, max_rows,
                 lambda v: F.coalesce(F.col(v), F.col(f"__prev_{v}"), F.col(f"__next_{v}")), split)


def impute_mean(df: DataFrame, variables: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """Missing cells take the mean of the observed cells of their variable."""
    joined, stat = attach_stats(df, variables, ("avg",), group_cols)
    return joined.withColumns({v: F.coalesce(F.col(v), stat(v, "avg")) for v in variables}).select(*df.columns)


def impute(df: DataFrame, variables: Sequence[str], method: str, order: Sequence[str] = ORDER,
           group_cols: Sequence[str] = (), max_rows: int | None = None, split: bool | None = None) -> DataFrame:
    """Fill gaps by 'mean', 'interpolation' or 'last_observed'."""
    if method not in METHODS:
        raise ValueError(f"method {method!r} is not one of {METHODS}")
    if method == "mean":
        return impute_mean(df, variables, group_cols)
    fill = impute_interpolate if method == "interpolation" else impute_locf
    return fill(df, variables, order, group_cols, max_rows, split)


def gap_islands(df: DataFrame, variables: Sequence[str], order: Sequence[str] = ORDER,
                group_cols: Sequence[str] = (), max_rows: int | None = None) -> DataFrame:
    """Maximal runs of missing cells: (groups..., variable, start_t, end_t, length).

    A run is named by the observed cell before it, so long runs aggregate partially and may span buckets.
    """
    rank = F.struct(*[F.col(c) for c in order])
    marked, split = with_buckets(df, order, group_cols, max_rows)
    seen = {f"__seen_{v}": F.when(F.col(v).isNotNull(), rank) for v in variables}
    up = (Window.partitionBy(*group_cols, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    runs = marked.withColumns({n: F.last(c, ignorenulls=True).over(up) for n, c in seen.items()})
    if split:
        ends = bucket_ends(marked, variables, order, group_cols, ("last",), "row_id")
        carried = carry_in(ends, variables, group_cols, ("last",))
        runs = join_groups(runs, F.broadcast(carried), [*group_cols, BUCKET])
        runs = runs.withColumns({f"__seen_{v}": F.coalesce(F.col(f"__seen_{v}"), F.when(
            F.col(f"before_{v}").isNotNull(),
            F.struct(F.col(f"before_t_{v}").alias(order[0]), F.col(f"before_{v}").alias(order[1])))) for v in variables})
    cells = F.explode(F.array(*[
        F.when(F.col(v).isNull(), F.struct(F.lit(v).alias("variable"), F.col(f"__seen_{v}").alias("after")))
        for v in variables]))
    t = order[0]
    return (runs.select(*group_cols, t, cells.alias("cell")).filter(F.col("cell").isNotNull())
            .groupBy(*group_cols, F.col("cell.variable").alias("variable"), F.col("cell.after").alias("after"))
            .agg(F.min(t).alias("start_t"), F.max(t).alias("end_t"), F.count(F.lit(1)).alias("length"))
            .drop("after"))
