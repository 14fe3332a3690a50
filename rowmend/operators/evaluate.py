"""Scoring filled tables: error against the truth, feasibility, plausibility, and the tables behind the reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyed import join_groups
from .pca import fit_pca, score_rows
from .scaling import column_stats
from .selection import IMPUTED, REPLACED, label, to_cells


def truth_stats(truth: DataFrame, variables: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """Rows (groups..., variable, mean, std with ddof 0, range) of the complete table."""
    wide = column_stats(truth, variables, ("avg", "sd_pop", "min", "max"), group_cols)
    entry = F.explode(F.array(*[F.struct(
        F.lit(v).alias("variable"), F.col(f"avg_{v}").alias("mean"), F.col(f"sd_pop_{v}").alias("std"),
        (F.col(f"max_{v}") - F.col(f"min_{v}")).alias("range")) for v in variables])).alias("s")
    return wide.select(*group_cols, entry).select(*group_cols, "s.*")


def scored_cells(filled: DataFrame, truth: DataFrame, masked: DataFrame, variables: Sequence[str],
                 keys: Sequence[str] = ("row_id",), truth_keys: Sequence[str] = ("row_id",)) -> DataFrame:
    """Wide table per row: estimate `<v>`, truth `__true_<v>` and `__gap_<v>` (was the cell missing); joined by key, so rows
    removed on the way do not shift anything.  A null in a key equals a null."""
    true = truth.select(*truth_keys, *[F.col(v).alias(f"__true_{v}") for v in variables])
    gaps = masked.select(*keys, *[F.col(v).isNull().alias(f"__gap_{v}") for v in variables])
    both = join_groups(filled.select(*keys, *variables), gaps, list(keys), "inner")
    return join_groups(both, true, list(truth_keys), "inner")


def nrmse(filled: DataFrame, truth: DataFrame, masked: DataFrame, variables: Sequence[str],
          keys: Sequence[str] = ("row_id",), truth_keys: Sequence[str] = ("row_id",), group_cols: Sequence[str] = (),
          normaliser: str = "std") -> DataFrame:
    """Normalised error on the missing cells: one row per variable, and variable NULL for all cells together.

    `normaliser` is the truth's 'std' (ddof 0) or 'range', of each group if the truth has the groups; a variable without missing
    cells scores 0.
    """
    if normaliser not in ("std", "range"):
        raise ValueError(f"normaliser {normaliser!r} is not 'std' or 'range'")
    own = [c for c in group_cols if c in truth_keys]  # the truth has these groups too, each with its own spread
    unit = truth_stats(truth, variables, own).select(*own, "variable", F.col(normaliser).alias("unit"))
    wide = scored_cells(filled, truth, masked, variables, keys, truth_keys)
    parts = []
    for v in variables:
        error = F.col(v) - F.col(f"__true_{v}")
        parts += [F.sum(F.when(F.col(f"__gap_{v}"), error * error)).alias(f"sq_{v}"),
                  F.sum(F.col(f"__gap_{v}").cast("bigint")).alias(f"n_{v}")]
    sums = wide.groupBy(*group_cols).agg(*parts)
    cells = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"sq_{v}").alias("sq"), F.col(f"n_{v}").alias("n"))
                                for v in variables])).alias("c")
    long = join_groups(sums.select(*group_cols, cells).select(*group_cols, "c.*"), unit, [*own, "variable"], "inner")
    squares = F.sum(F.col("sq") / F.nullif(F.col("unit") * F.col("unit"), F.lit(0.0)))
    score = F.coalesce(F.sqrt(squares / F.nullif(F.sum("n"), F.lit(0))), F.lit(0.0)).alias("nrmse")
    if not group_cols:
        return long.rollup("variable").agg(score)
    per_variable = long.groupBy(*group_cols, "variable").agg(score)
    overall = long.groupBy(*group_cols).agg(score).withColumn("variable", F.lit(None).cast("string"))
    return per_variable.unionByName(overall)


def nrmse_per_variable(*args, **kwargs) -> DataFrame:
    return nrmse(*args, **kwargs).filter(F.col("variable").isNotNull())


def nrmse_overall(*args, **kwargs) -> DataFrame:
    return nrmse(*args, **kwargs).filter(F.col("variable").isNull()).drop("variable")


def missing_nrmse(filled: DataFrame, truth: DataFrame, masked: DataFrame, variables: Sequence[str],
                  keys: Sequence[str] = ("row_id",), group_cols: Sequence[str] = ()) -> DataFrame:
    """(nrmse, rmse), by group if asked: root mean squared error on the missing cells, over the sample deviation of their truth."""
    wide = scored_cells(filled, truth, masked, variables, keys, keys)
    cells = wide.select(*group_cols, F.explode(F.array(*[F.when(F.col(f"__gap_{v}"), F.struct(
        F.col(v).alias("x"), F.col(f"__true_{v}").alias("y"))) for v in variables])).alias("c")).filter("c is not null")
    rmse = F.sqrt(F.avg((F.col("c.x") - F.col("c.y")) * (F.col("c.x") - F.col("c.y"))))
    return cells.groupBy(*group_cols).agg((rmse / F.nullif(F.stddev_samp("c.y"), F.lit(0.0))).alias("nrmse"), rmse.alias("rmse"))


def _count_where(conditions: list[Column], alias: str) -> Column:
    return F.sum(reduce(lambda a, b: a + b, [
        F.coalesce(c, F.lit(False)).cast("bigint") for c in conditions])).alias(alias)


def _with_gaps(filled, masked, variables, keys) -> DataFrame:
    gaps = masked.select(*keys, *[F.col(v).isNull().alias(f"__gap_{v}") for v in variables])
    return join_groups(filled, gaps, list(keys), "inner")


def feasibility(filled: DataFrame, masked: DataFrame, metadata: DataFrame, variables: Sequence[str],
                keys: Sequence[str] = ("row_id",), group_cols: Sequence[str] = ()) -> DataFrame:
    """Number of imputed cells outside the variable's bounds."""
    bounds = {r["variable"]: (r["lb"], r["ub"]) for r in metadata.filter(F.col("variable").isin(list(variables))).collect()}
    outside = [F.col(f"__gap_{v}") & ((F.col(v) < F.lit(bounds[v][0])) | (F.col(v) > F.lit(bounds[v][1])))
               for v in variables if v in bounds]
    return _with_gaps(filled, masked, variables, keys).groupBy(*group_cols).agg(_count_where(outside, "feasibility"))


def plausibility(filled: DataFrame, masked: DataFrame, variables: Sequence[str], components: int | dict,
                 keys: Sequence[str] = ("row_id",), group_cols: Sequence[str] = (), contrib: str = "2D-Chiang",
                 lim: float = 0.9999, lim_method: str = "norm") -> DataFrame:
    """Number of imputed cells that a PCA model of the filled table calls outliers."""
    models = fit_pca(filled, variables, components, contrib=contrib, lim=lim, lim_method=lim_method,
                     group_cols=group_cols, row_limits=False)
    scored = score_rows(_with_gaps(filled, masked, variables, keys), models, ("flag",), group_cols)
    hits = [F.col(f"__gap_{v}") & (F.col(f"flag_{v}") > 0) for v in variables]
    return scored.groupBy(*group_cols).agg(_count_where(hits, "plausibility"))


def label_counts(df: DataFrame, variables: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """Cells per variable and label, with totals (NULL) over either: (groups..., variable, label, n)."""
    cells = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(label(v)).alias("label"))
                                for v in variables])).alias("c")
    cells = df.select(*group_cols, cells).select(*group_cols, "c.*")
    if not group_cols:
        return cells.cube("variable", "label").agg(F.count(F.lit(1)).alias("n"))
    counts = cells.groupBy(*group_cols, "variable", "label").agg(F.count(F.lit(1)).alias("n"))
    entry = F.explode(F.array(*[F.struct(F.when(F.lit(v), F.col("variable")).alias("variable"), F.when(F.lit(b), F.col("label")).alias("label"))
                                for v in (True, False) for b in (True, False)])).alias("c")
    return counts.select(*group_cols, entry, "n").groupBy(*group_cols, "c").agg(F.sum("n").alias("n")).select(*group_cols, "c.*", "n")


def before_after(original: DataFrame, filled: DataFrame, variables: Sequence[str], row_id: str = "row_id",
                 group_cols: Sequence[str] = ()) -> DataFrame:
    """Re-estimated cells with their old value (NULL if missing) and new value; `original` carries the labels
    'imputed' and 'replaced'.  Rows are matched by groups and row id."""
    keys = [*group_cols, row_id]
    new = filled.select(*keys, *[F.col(v).alias(f"__new_{v}") for v in variables])
    wide = join_groups(original, new, keys, "inner")
    entry = F.explode(F.array(*[F.when(F.col(label(v)).isin(IMPUTED, REPLACED), F.struct(
        F.lit(v).alias("variable"), F.col(label(v)).alias("label"), F.col(v).alias("before"),
        F.col(f"__new_{v}").alias("after"))) for v in variables])).alias("c")
    return wide.select(*keys, entry).filter("c is not null").select(*keys, "c.*")


def cells_by_label(df: DataFrame, variables: Sequence[str], t: str = "t", row_id: str = "row_id") -> DataFrame:
    """The series behind the per-variable plots: (row_id, t, variable, value, label)."""
    return to_cells(df, variables, [row_id, t])
