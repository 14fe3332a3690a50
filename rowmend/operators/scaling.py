"""Column statistics and scaling, all in JVM expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyed import join_groups

_STATS = {
    "n": F.count,
    "avg": F.avg,
    "sd": F.stddev_samp,
    "sd_pop": F.stddev_pop,
    "min": F.min,
    "max": F.max,
}


def column_stats(df: DataFrame, variables: Sequence[str], stats: Sequence[str],
                 group_cols: Sequence[str] = ()) -> DataFrame:
    """One row per group with columns `<stat>_<variable>`, over the observed cells."""
    return df.groupBy(*group_cols).agg(*[_STATS[s](v).cast("double").alias(f"{s}_{v}") for s in stats for v in variables])


def stats_by_group(df: DataFrame, variables: Sequence[str], stats: Sequence[str],
                   group_cols: Sequence[str] = ()) -> dict[tuple, dict[str, np.ndarray]]:
    """The same numbers on the driver: {group: {stat: vector}} (groups x variables numbers)."""
    rows = column_stats(df, variables, stats, group_cols).collect()
    return {tuple(r[c] for c in group_cols):
            {s: np.array([np.nan if r[f"{s}_{v}"] is None else r[f"{s}_{v}"] for v in variables]) for s in stats}
            for r in rows}


def attach_stats(df: DataFrame, variables: Sequence[str], stats: Sequence[str],
                 group_cols: Sequence[str] = ()) -> tuple[DataFrame, Callable[[str, str], Column]]:
    """Make statistics available as columns: literals for one matrix, an equi-join for many.

    The join is left to Spark: it broadcasts the statistics only while they are below the session's threshold.
    """
    table = column_stats(df, variables, stats, group_cols)
    if group_cols:
        renamed = table.select(*group_cols, *[F.col(f"{s}_{v}").alias(f"__{s}_{v}") for s in stats for v in variables])
        return join_groups(df, renamed, group_cols), lambda v, s: F.col(f"__{s}_{v}")
    row = table.first()
    return df, lambda v, s: F.lit(row[f"{s}_{v}"]).cast("double")


def scale_column(x: Column, mu: Column, sigma: Column) -> Column:
    """(x - mu) / sigma, and 0 for an observed cell of a variable without spread."""
    return F.when(sigma == 0, F.when(x.isNotNull(), F.lit(0.0))).otherwise(
        (x - mu) / F.nullif(sigma, F.lit(0.0)))


def scale_by(df: DataFrame, mu: Mapping[str, float], sigma: Mapping[str, float]) -> DataFrame:
    return df.withColumns({v: scale_column(F.col(v), F.lit(float(mu[v])), F.lit(float(sigma[v]))) for v in mu})


def rescale_by(df: DataFrame, mu: Mapping[str, float], sigma: Mapping[str, float]) -> DataFrame:
    return df.withColumns({v: F.col(v) * F.lit(float(sigma[v])) + F.lit(float(mu[v])) for v in mu})


MODES = ("none", "mean_center", "standardize")


def preprocess(df: DataFrame, variables: Sequence[str], mode: str = "standardize", ddof: int = 1,
               group_cols: Sequence[str] = ()) -> DataFrame:
    """Centre and scale: 'none', 'mean_center' or 'standardize' (sample deviation for ddof 1, population for ddof 0)."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is not one of {MODES}")
    if mode == "none":
        return df
    sd = "sd" if ddof else "sd_pop"
    joined, stat = attach_stats(df, variables, ("n", "avg", "sd", "sd_pop"), group_cols)
    if mode == "mean_center":
        scaled = {v: F.col(v) - stat(v, "avg") for v in variables}
    else:
        # a deviation below the rounding noise of the whole table counts as none
        squares = [stat(v, "n") * (stat(v, "avg") * stat(v, "avg") + stat(v, "sd_pop") * stat(v, "sd_pop")) for v in variables]
        floor = F.lit(3 * np.finfo(float).eps) * F.sqrt(reduce(lambda a, b: a + b, squares))
        scaled = {v: scale_column(F.col(v), stat(v, "avg"), F.when(stat(v, sd) >= floor, stat(v, sd)).otherwise(0.0))
                  for v in variables}
    return joined.withColumns(scaled).select(*df.columns)


def autoscale(df: DataFrame, variables: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """Zero mean and unit sample variance, ignoring missing cells."""
    return preprocess(df, variables, "standardize", 1, group_cols)


def standardize_pop(df: DataFrame, variables: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """Zero mean and unit population variance, the scaling used before imputation."""
    return preprocess(df, variables, "standardize", 0, group_cols)


def normalize(df: DataFrame, variables: Sequence[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Scale observed cells and return the function that undoes it."""
    stats = stats_by_group(df, variables, ("avg", "sd"))[()]
    mu, sigma = dict(zip(variables, stats["avg"])), dict(zip(variables, stats["sd"]))
    return scale_by(df, mu, sigma), lambda scaled: rescale_by(scaled, mu, sigma)
