"""Second moments of complete tables, total and per cross-validation fold."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import SLOTS, uniform
from .matrix import check_driver_size, sum_stats
from .scaling import stats_by_group


@dataclass
class Moments:
    """n, sum and sum of outer products of rows measured from `shift` in units of `unit`."""

    n: float
    s: np.ndarray
    g: np.ndarray
    shift: np.ndarray
    unit: np.ndarray

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.s - other.s, self.g - other.g, self.shift, self.unit)

    @property
    def mean(self) -> np.ndarray:
        return self.shift + self.unit * self.s / self.n

    def covariance(self, ddof: int = 1) -> np.ndarray:
        central = self.g - np.outer(self.s, self.s) / self.n
        return central * np.outer(self.unit, self.unit) / (self.n - ddof)

    def second(self, center: np.ndarray) -> np.ndarray:
        """Sum of (x - center)(x - center)'."""
        d = (self.shift - center) / self.unit
        g = self.g + np.outer(d, self.s) + np.outer(self.s, d) + self.n * np.outer(d, d)
        return g * np.outer(self.unit, self.unit)

    def deviation(self, ddof: int = 1) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.covariance(ddof)), 0.0))


def pack(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])


def unpack(vector: np.ndarray, shift: np.ndarray, unit: np.ndarray) -> Moments:
    v = len(shift)
    return Moments(vector[0], vector[1:1 + v], vector[1 + v:1 + v + v * v].reshape(v, v), shift, unit)


def location_and_unit(df: DataFrame, variables: Sequence[str], group_cols: Sequence[str] = ()):
    """{group: (mean, deviation or 1)} used to pre-centre rows, so that sums of products do not cancel."""
    stats = stats_by_group(df, variables, ("n", "avg", "sd_pop"), group_cols)
    check_driver_size(len(stats), 3 * len(variables))
    for key, s in stats.items():
        empty = [v for v, n in zip(variables, s["n"]) if n == 0]
        if empty:
            raise ValueError(f"variables without any value{f' in group {key}' if key else ''}: {empty}")
    return {k: (s["avg"], np.where(s["sd_pop"] > 0, s["sd_pop"], 1.0)) for k, s in stats.items()}


def moments(df: DataFrame, variables: Sequence[str], group_cols: Sequence[str] = (),
            scale: dict | None = None) -> dict[tuple, Moments]:
    """Moments of a complete table, per group, in one pass (plus one for the means unless `scale` is given)."""
    scale = scale or location_and_unit(df, variables, group_cols)
    check_driver_size(len(scale), (len(variables) + 1) ** 2)

    def kernel(key, x):
        mu, unit = scale[key]
        z = (x - mu) / unit
        complete = ~np.isnan(z).any(axis=1)
        return np.append(pack(z[complete]), (~complete).sum())

    sums = sum_stats(df, {"x": variables}, kernel, group_cols)
    incomplete = sum(v[-1] for v in sums.values())
    if incomplete:
        raise ValueError(f"{int(incomplete)} rows have missing cells; impute them first")
    return {k: unpack(v, *scale[k]) for k, v in sums.items()}


def fold_names(num_repeat: int) -> list[str]:
    return [f"fold_{r}" for r in range(num_repeat)]


def with_folds(df: DataFrame, n_splits: int = 5, num_repeat: int = 1, seed: int = 0, row_id: str = "row_id") -> DataFrame:
    """Repeated shuffled k-fold: one column per repeat with the fold number of each row."""
    return df.withColumns({
        name: F.floor(uniform(seed, r // SLOTS, F.col(row_id), slot=r % SLOTS) * n_splits).cast("int")
        for r, name in enumerate(fold_names(num_repeat))})


def pack_folds(n_splits: int, num_repeat: int, name: str = "__folds") -> dict[str, Column]:
    """The fold columns as digits of few numbers, for a table that is stored between passes; a draw is dearer than a digit."""
    each = max(1, int(62 / np.log2(max(n_splits, 2))))
    names = fold_names(num_repeat)
    return {f"{name}{i}": reduce(lambda a, b: a * n_splits + b, [F.col(c).cast("bigint") for c in reversed(names[i * each:(i + 1) * each])])
            for i in range(-(-num_repeat // each))}


def unpack_folds(df: DataFrame, n_splits: int, num_repeat: int, name: str = "__folds") -> DataFrame:
    """The fold columns in place of what `pack_folds` made of them."""
    each = max(1, int(62 / np.log2(max(n_splits, 2))))
    return df.withColumns({c: F.expr(f"int(({name}{r // each} div {n_splits ** (r % each)}L) % {n_splits}L)")
                           for r, c in enumerate(fold_names(num_repeat))})


def fold_moments(df: DataFrame, variables: Sequence[str], n_splits: int, num_repeat: int,
                 group_cols: Sequence[str] = (), scale: dict | None = None, drop_incomplete: bool = False,
                 ) -> dict[tuple, tuple[Moments, list[Moments]]]:
    """{group: (total, [moments of every fold of every repeat])} in one pass over a table made by `with_folds`.

    No training set is ever materialised: its moments are total minus fold.
    """
    scale = scale or location_and_unit(df, variables, group_cols)
    v = len(variables)
    width = 1 + v + v * v
    check_driver_size(len(scale), width * n_splits * num_repeat)

    def kernel(key, x, folds):
        mu, unit = scale[key]
        z = (x - mu) / unit
        complete = ~np.isnan(z).any(axis=1)
        z, folds = z[complete], folds[complete]
        return np.concatenate([pack(z[folds[:, r] == f]) for r in range(num_repeat) for f in range(n_splits)]
                              + [[float((~complete).sum())]])

    sums = sum_stats(df, {"x": variables, "folds": fold_names(num_repeat)}, kernel, group_cols)
    incomplete = sum(s[-1] for s in sums.values())
    if incomplete and not drop_incomplete:
        raise ValueError(f"{int(incomplete)} rows have missing cells; impute them first")
    out = {}
    for key, vector in sums.items():
        parts = vector[:-1].reshape(num_repeat * n_splits, width)
        out[key] = (unpack(parts[:n_splits].sum(axis=0), *scale[key]), [unpack(p, *scale[key]) for p in parts])
    return out


def matrix_table(spark, matrices: dict[tuple, np.ndarray], variables: Sequence[str], group_fields=(),
                 name: str = "value") -> DataFrame:
    """V x V matrices as rows (groups..., variable_i, variable_j, value)."""
    from pyspark.sql import types as T

    rows = [(*key, vi, vj, float(m[i, j])) for key, m in matrices.items()
            for i, vi in enumerate(variables) for j, vj in enumerate(variables)]
    schema = T.StructType([*group_fields, T.StructField("variable_i", T.StringType()),
                           T.StructField("variable_j", T.StringType()), T.StructField(name, T.DoubleType())])
    return spark.createDataFrame(rows, schema)


def covariance(df: DataFrame, variables: Sequence[str], group_cols: Sequence[str] = (), ddof: int = 1) -> DataFrame:
    """Covariance matrix as rows (groups..., variable_i, variable_j, covariance)."""
    found = {k: m.covariance(ddof) for k, m in moments(df, variables, group_cols).items()}
    return matrix_table(df.sparkSession, found, variables, [df.schema[c] for c in group_cols], "covariance")
