"""How many components: element-wise k-fold cross-validation from per-fold moments."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linalg import leading_eigen
from ..functions.quantiles import norm_ppf
from .moments import Moments, fold_moments, with_folds

EPS = np.finfo(float).eps


def max_components(n_rows: float, n_vars: int, n_splits: int, upper: int | None = None) -> int:
    """Rows of a training set, the caller's bound and the number of variables all cap the candidates."""
    return int(min(np.floor(n_rows * (1 - 1 / n_splits)), n_vars, upper or n_vars))


def split_press(total: Moments, fold: Moments, n_components: int, mode: str = "standardize", ddof: int = 1) -> np.ndarray:
    """PRESS of one split for 1..n components; the rows of both sets are only known through their moments.

    With R the replacement matrix, the mean over variables of the summed squared errors of the left-out rows is
    tr(R' G R) / V, G being the second moment of those rows in the scaling of the training set.
    """
    train = total - fold
    mu = train.mean
    sigma = train.deviation(ddof) if mode == "standardize" else np.ones(len(mu))
    inverse = np.where(sigma == 0, 0.0, 1.0 / np.where(sigma == 0, 1.0, sigma))
    unit = np.outer(inverse, inverse)
    _, p = leading_eigen(train.covariance(1) * unit, n_components)
    g = fold.second(mu) * unit
    v = len(mu)
    press = np.empty(n_components)
    used: list[int] = []
    for a in range(n_components):
        # what the components leave of each variable; one that would leave nothing of some variable is not used
        left = 1.0 - (p[:, [*used, a]] ** 2).sum(axis=1)
        if left.min() >= 10 * EPS:
            used.append(a)
        basis = p[:, used]
        replacement = np.eye(v) - basis @ basis.T
        errors = replacement / np.maximum(np.diag(replacement), EPS)
        press[a] = np.trace(errors.T @ g @ errors) / v
    return press


def press_matrix(total: Moments, folds: list[Moments], n_splits: int, upper: int | None = None,
                 mode: str = "standardize", ddof: int = 1) -> np.ndarray:
    """Components x splits."""
    a = max_components(total.n, len(total.s), n_splits, upper)
    usable = [f for f in folds if 0 < f.n < total.n - 1]
    return np.column_stack([split_press(total, f, a, mode, ddof) for f in usable])


def without_outlier_splits(press: np.ndarray, level: float = 0.999) -> np.ndarray:
    limit = press.mean(axis=1) + norm_ppf(level) * press.std(axis=1)
    return press[:, ~(press > limit[:, None]).all(axis=0)]


def one_standard_error(press: np.ndarray, se_rule: float = 1.0) -> int:
    """Smallest number of components within `se_rule` standard errors of the best mean PRESS."""
    mean = press.mean(axis=1)
    best = int(mean.argmin())
    spread = press[best].std(ddof=1) / np.sqrt(press.shape[1]) if press.shape[1] > 1 else 0.0
    inside = np.flatnonzero(mean < mean[best] + se_rule * spread)
    return int(inside[0] if len(inside) else best) + 1


def choose_components(total: Moments, folds: list[Moments], n_splits: int, upper: int | None = None,
                      se_rule: float = 1.0) -> int:
    return one_standard_error(without_outlier_splits(press_matrix(total, folds, n_splits, upper)), se_rule)


def select_components(df: DataFrame, variables: Sequence[str], n_splits: int = 5, num_repeat: int = 10,
                      upper: int | None = None, se_rule: float = 1.0, seed: int = 0, row_id: str = "row_id",
                      group_cols: Sequence[str] = (), scale: dict | None = None) -> dict[tuple, int]:
    """Cross-validated number of components per group, in one pass over a complete table (plus one for the means unless `scale` is given)."""
    folded = with_folds(df, n_splits, num_repeat, seed, row_id)
    found = fold_moments(folded, variables, n_splits, num_repeat, group_cols, scale)
    return {k: choose_components(t, f, n_splits, upper, se_rule) for k, (t, f) in found.items()}


def press_table(df: DataFrame, variables: Sequence[str], n_splits: int = 5, num_repeat: int = 10,
                upper: int | None = None, seed: int = 0, row_id: str = "row_id") -> DataFrame:
    """Rows (split, component, press)."""
    folded = with_folds(df, n_splits, num_repeat, seed, row_id)
    total, folds = fold_moments(folded, variables, n_splits, num_repeat)[()]
    press = press_matrix(total, folds, n_splits, upper)
    rows = [(s, a + 1, float(press[a, s])) for a in range(press.shape[0]) for s in range(press.shape[1])]
    return df.sparkSession.createDataFrame(rows, "split int, component int, press double")


def drop_outlier_splits(press: DataFrame, level: float = 0.999) -> DataFrame:
    """Leave out splits whose PRESS is beyond the normal limit for every number of components."""
    per_a = Window.partitionBy("component")
    per_split = Window.partitionBy("split")
    over = F.col("press") > F.avg("press").over(per_a) + F.lit(norm_ppf(level)) * F.stddev_pop("press").over(per_a)
    return (press.withColumn("__over", over).withColumn("__all", F.bool_and("__over").over(per_split))
            .filter(~F.col("__all")).drop("__over", "__all"))


def one_se_rule(press: DataFrame, se_rule: float = 1.0) -> DataFrame:
    """One row (component): the choice of `one_standard_error` on a stored PRESS table."""
    per_a = press.groupBy("component").agg(
        F.avg("press").alias("m"),
        F.coalesce(F.stddev_samp("press") / F.sqrt(F.count("press")), F.lit(0.0)).alias("se"))
    everything = Window.partitionBy()  # at most one row per variable
    bound = F.min_by(F.col("m") + F.lit(se_rule) * F.col("se"), F.col("m")).over(everything)
    best = F.min("m").over(everything)
    return (per_a.withColumn("bound", bound).withColumn("best", best)
            .filter((F.col("m") < F.col("bound")) | (F.col("m") == F.col("best")))
            .agg(F.min("component").alias("component")))


def cross_validate_pca(df: DataFrame, variables: Sequence[str], a: int | None = None, n_splits: int = 7,
                       mode: str = "standardize", seed: int = 11, row_id: str = "row_id",
                       ) -> tuple[np.ndarray, np.ndarray]:
    """(RMSECV per component, PRESS components x splits) of a single k-fold split; RMSECV divides by all rows."""
    if mode not in ("standardize", "mean_center"):
        raise ValueError(f"mode {mode!r} is not one of ('standardize', 'mean_center')")
    if a is not None and a > len(variables):
        raise ValueError(f"{a} components exceed {len(variables)} variables")
    folded = with_folds(df, n_splits, 1, seed, row_id)
    total, folds = fold_moments(folded, variables, n_splits, 1)[()]
    press = press_matrix(total, folds, n_splits, a, mode, ddof=0)
    return np.sqrt(press.sum(axis=1) / total.n), press


def argmin_rmsecv_by_group(df: DataFrame, variables: Sequence[str], n_splits: int = 7, seed: int = 11, row_id: str = "row_id",
                           group_cols: Sequence[str] = (), found: dict | None = None) -> dict[tuple, int]:
    """Per group the number of components with the smallest RMSECV among the first 80 % of the possible ones; one pass for all,
    which is skipped if the moments of the folds are given."""
    upper = max(1, round(0.8 * len(variables)))
    found = found or fold_moments(with_folds(df, n_splits, 1, seed, row_id), variables, n_splits, 1, group_cols)
    return {k: int(press_matrix(total, folds, n_splits, upper, ddof=0).sum(axis=1).argmin()) + 1 for k, (total, folds) in found.items()}


def argmin_rmsecv(df: DataFrame, variables: Sequence[str], n_splits: int = 7, seed: int = 11, row_id: str = "row_id") -> int:
    """The choice of `argmin_rmsecv_by_group` for one table."""
    return argmin_rmsecv_by_group(df, variables, n_splits, seed, row_id)[()]
