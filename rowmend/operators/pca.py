"""PCA monitoring models: fit from distributed Gram matrices, score rows, contributions and control limits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.linalg import leading_eigen
from ..functions.quantiles import chi2_ppf, norm_ppf, t_ppf
from .keyed import join_groups
from .matrix import row_map, sum_stats
from .moments import Moments, moments
from .scaling import MODES

# Fixed option values of the model builder.
CONTRIBUTIONS = ("simple", "absolute", "2D-Chiang", "2D-Alcala")
LIMIT_METHODS = ("norm", "t", "2D-Alcala")
DENOMINATOR_FLOOR = 1e-10


@dataclass
class PcaModel:
    """Everything needed to score rows; V x A numbers, no row data."""

    variables: list[str]
    n: int
    mu: np.ndarray
    sigma: np.ndarray
    p: np.ndarray
    sigma_sq: np.ndarray
    second: np.ndarray  # X'X of the scaled table
    cov: np.ndarray  # covariance of the scaled table, ddof 1
    contrib: str = "simple"
    lim: float = 0.95
    lim_method: str = "norm"
    ddof: int = 0
    limits: dict = field(default_factory=dict)

    @property
    def a(self) -> int:
        return self.p.shape[1]

    @property
    def d(self) -> np.ndarray:
        return (self.p / self.sigma_sq) @ self.p.T

    @property
    def c(self) -> np.ndarray:
        return np.eye(len(self.variables)) - self.p @ self.p.T

    def scale(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mu) * np.where(self.sigma == 0, 0.0, 1.0 / np.where(self.sigma == 0, 1.0, self.sigma))

    def statistics(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = z @ self.p
        return (t * t / self.sigma_sq).sum(axis=1), ((z - t @ self.p.T) ** 2).sum(axis=1)

    def contributions(self, z: np.ndarray, positive_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Per-cell shares of T2 and of the squared residual."""
        t = z @ self.p
        e = z - t @ self.p.T
        if self.contrib == "simple":
            return (t / np.sqrt(self.sigma_sq)) @ self.p.T, e
        if self.contrib == "absolute":
            return (t / np.sqrt(self.sigma_sq)) @ self.p.T * z, e * e
        if self.contrib == "2D-Chiang":
            if positive_only:  # negative terms of single components are dropped before adding
                terms = (t / self.sigma_sq)[:, None, :] * z[:, :, None] * self.p[None]
                return np.maximum(terms, 0.0).sum(axis=2), e * e
            return z * (z @ self.d), e * e
        return _ratio((z @ self.d) ** 2, np.diag(self.d)), _ratio((z @ self.c) ** 2, np.diag(self.c))


def _ratio(numerator: np.ndarray, denominator: np.ndarray) -> np.ndarray:
    usable = denominator > DENOMINATOR_FLOOR
    return np.where(usable, numerator / np.where(usable, denominator, 1.0), 0.0)


def pca_from_moments(m: Moments, variables: Sequence[str], a: int, preprocess: str = "standardize",
                     contrib: str = "simple", lim: float = 0.95, lim_method: str = "norm", ddof: int = 0) -> PcaModel:
    """The part of the fit that only needs the V x V moments."""
    for value, allowed in ((preprocess, MODES), (contrib, CONTRIBUTIONS), (lim_method, LIMIT_METHODS)):
        if value not in allowed:
            raise ValueError(f"{value!r} is not one of {allowed}")
    v, n = len(variables), m.n
    if not 1 <= a <= min(n, v):
        raise ValueError(f"number of components {a} must be between 1 and min(rows, variables) = {int(min(n, v))}")
    mu = np.zeros(v) if preprocess == "none" else m.mean
    sigma = np.ones(v)
    if preprocess == "standardize":
        sigma = m.deviation(1)
        # Spread below rounding noise of the data counts as none.
        scale = np.sqrt(np.trace(m.second(np.zeros(v))))
        sigma = np.where(sigma < 3 * np.finfo(float).eps * scale, 0.0, sigma)
    inverse = np.where(sigma == 0, 0.0, 1.0 / np.where(sigma == 0, 1.0, sigma))
    second = m.second(mu) * np.outer(inverse, inverse)
    mean_z = (m.mean - mu) * inverse
    _, p = leading_eigen(second / (n - 1), a)
    central = second - n * np.outer(mean_z, mean_z)
    sigma_sq = np.einsum("va,vw,wa->a", p, central, p) / (n - ddof)
    if (sigma_sq <= 0).any():
        raise ValueError(f"component {int(np.argmax(sigma_sq <= 0)) + 1} has no variance; use fewer components")
    return PcaModel(list(variables), int(n), mu, sigma, p, sigma_sq, second, central / (n - 1),
                    contrib, lim, lim_method, ddof)


def _box_limit(mean: float, var: float, lim: float) -> float:
    dof = 2 * mean * mean / var
    return mean / dof * chi2_ppf(lim, dof)


def limit_stats(df: DataFrame, models: dict[tuple, PcaModel], group_cols: Sequence[str] = ()) -> dict[tuple, np.ndarray]:
    """Sums of T2, SRE, both contributions and their squares, in one pass."""
    variables = next(iter(models.values())).variables

    return sum_stats(df, {"x": variables}, lambda key, x: limit_kernel(models[key], x), group_cols)


def limit_kernel(model: PcaModel, x: np.ndarray) -> np.ndarray:
    z = model.scale(x)
    t2, sre = model.statistics(z)
    ct, cq = model.contributions(z)
    values = np.column_stack([t2, sre, ct, cq])
    return np.concatenate([values.sum(axis=0), (values * values).sum(axis=0)])


def over_limit(model: PcaModel, x: np.ndarray) -> np.ndarray:
    """Mask of the cells with a contribution beyond its limit."""
    ct, cq = model.contributions(model.scale(x))
    return (np.abs(ct) > model.limits["T_sq_con"]) | (np.abs(cq) > model.limits["SRE_con"])


def set_limits(model: PcaModel, sums: np.ndarray | None) -> PcaModel:
    """Control limits of the model; `sums` comes from `limit_stats` and is not needed for Alcala contribution limits alone."""
    n, v, lim = model.n, len(model.variables), model.lim
    level = lim + (1 - lim) / 2 if model.contrib == "simple" else lim
    limits = {"dof": np.arange(model.a) + 2}
    if sums is not None:
        mean = sums[:2 + 2 * v] / n
        squares = sums[2 + 2 * v:]
        var = np.maximum(squares / n - mean * mean, 0.0) * n / (n - model.ddof)
        limits["T_sq"] = _box_limit(mean[0], var[0], lim)
        limits["SRE"] = _box_limit(mean[1], var[1], lim) if mean[1] > 0 and var[1] > 0 else 0.0
    if model.lim_method == "norm":
        both = mean[2:] + norm_ppf(level) * np.sqrt(var[2:])
    elif model.lim_method == "t":
        dof = n - (model.a + 1)
        both = np.sqrt(squares[2:] / dof) * t_ppf(level, dof)
    else:
        z = chi2_ppf(lim, 1)
        both = np.concatenate([
            z * _ratio(np.diag(w @ model.cov @ w), np.diag(w)) for w in (model.d, model.c)])
    limits["T_sq_con"], limits["SRE_con"] = both[:v], both[v:]
    model.limits = limits
    return model


def fit_pca(df: DataFrame, variables: Sequence[str], a: int | dict, preprocess: str = "standardize",
            contrib: str = "simple", lim: float = 0.95, lim_method: str = "norm", ddof: int = 0,
            group_cols: Sequence[str] = (), found: dict[tuple, Moments] | None = None,
            row_limits: bool = True) -> dict[tuple, PcaModel]:
    """Fit one model per group (the key is () without groups) on a complete table.

    Two scans at most: the Gram matrix (skipped if moments are given) and the sums behind the limits (skipped if only
    Alcala contribution limits are wanted).
    """
    found = found or moments(df, variables, group_cols)
    models = {k: pca_from_moments(m, variables, a[k] if isinstance(a, dict) else a, preprocess, contrib, lim,
                                  lim_method, ddof) for k, m in found.items()}
    need_rows = row_limits or lim_method != "2D-Alcala"
    sums = limit_stats(df, models, group_cols) if need_rows else {}
    return {k: set_limits(m, sums.get(k)) for k, m in models.items()}


OUTPUTS = ("scores", "reconstruction", "residual", "T_sq", "SRE", "T_sq_con", "SRE_con", "flag")


def output_names(variables: Sequence[str], a: int, what: str) -> list[str]:
    if what == "scores":
        return [f"score_{i + 1}" for i in range(a)]
    return [what] if what in ("T_sq", "SRE") else [f"{what}_{v}" for v in variables]


def score_rows(df: DataFrame, models: dict[tuple, PcaModel], outputs: Sequence[str],
               group_cols: Sequence[str] = ()) -> DataFrame:
    """Append diagnostic columns to every row; `flag_<v>` is 1 where a contribution is beyond its limit."""
    unknown = set(outputs) - set(OUTPUTS)
    if unknown:
        raise ValueError(f"unknown outputs {sorted(unknown)}")
    variables = next(iter(models.values())).variables
    a = max(m.a for m in models.values())
    names = [n for what in outputs for n in output_names(variables, a, what)]

    def fn(key, x):
        model = models[key]
        z = model.scale(x)
        parts = []
        for what in outputs:
            if what == "scores":
                part = np.full((len(z), a), np.nan)
                part[:, :model.a] = z @ model.p
            elif what == "reconstruction":
                part = z @ model.p @ model.p.T
            elif what == "residual":
                part = z - z @ model.p @ model.p.T
            elif what in ("T_sq", "SRE"):
                part = model.statistics(z)[what == "SRE"][:, None]
            elif what == "flag":
                part = over_limit(model, x).astype(float)
            else:
                part = model.contributions(z)[what == "SRE_con"]
            parts.append(part)
        return np.column_stack(parts)

    return row_map(df, {"x": variables}, fn, names, group_cols)


def row_control_chart(df: DataFrame, models: dict[tuple, PcaModel], group_cols: Sequence[str] = ()) -> DataFrame:
    """Rows whose T2 or squared residual is beyond the row limits."""
    over = None
    scored = score_rows(df, models, ("T_sq", "SRE"), group_cols)
    if not group_cols:
        lim = models[()].limits
        over = (F.col("T_sq") > lim["T_sq"]) | (F.col("SRE") > lim["SRE"])
        return scored.filter(over)
    rows = [(*k, float(m.limits["T_sq"]), float(m.limits["SRE"])) for k, m in models.items()]
    schema = T.StructType([df.schema[c] for c in group_cols]
                          + [T.StructField("__lt", T.DoubleType()), T.StructField("__ls", T.DoubleType())])
    limits = df.sparkSession.createDataFrame(rows, schema)
    over = (F.col("T_sq") > F.col("__lt")) | (F.col("SRE") > F.col("__ls"))
    return join_groups(scored, limits, group_cols).filter(over).drop("__lt", "__ls")


def model_table(spark, model: PcaModel) -> DataFrame:
    """One row per variable: scaling, loadings and contribution limits."""
    lim = model.limits
    rows = [(v, float(model.mu[i]), float(model.sigma[i]), [float(x) for x in model.p[i]],
             *(float(lim[k][i]) if k in lim else None for k in ("T_sq_con", "SRE_con")))
            for i, v in enumerate(model.variables)]
    return spark.createDataFrame(
        rows, "variable string, mu double, sigma double, loadings array<double>, lim_T_sq_con double, lim_SRE_con double")


def component_table(spark, model: PcaModel) -> DataFrame:
    """One row per component: score variance, explained and cumulative explained share of X'X."""
    share = np.einsum("va,vw,wa->a", model.p, model.second, model.p) / np.trace(model.second)
    rows = [(i + 1, float(model.sigma_sq[i]), float(share[i]), float(share[:i + 1].sum())) for i in range(model.a)]
    return spark.createDataFrame(rows, "component int, score_variance double, explained double, cumulative double")


def fit_performance(df: DataFrame, model: PcaModel) -> DataFrame:
    """SSE, bias and standard error of the reconstruction with 1..A components, in one pass."""
    def kernel(_, x):
        z = model.scale(x)
        t = z @ model.p
        out = []
        for i in range(1, model.a + 1):
            e = z - t[:, :i] @ model.p[:, :i].T
            out += [(e * e).sum(), e.sum()]
        return np.array(out)

    sums = sum_stats(df, {"x": model.variables}, kernel)[()].reshape(model.a, 2)
    cells = model.n * len(model.variables)
    rows = []
    for i, (sse, total) in enumerate(sums):
        bias = total / cells
        rows.append((i + 1, float(sse), float(bias), float(np.sqrt(max(sse - cells * bias * bias, 0.0) / (model.n - 1)))))
    return df.sparkSession.createDataFrame(rows, "component int, sse double, bias double, se double")


def pca_dual(df: DataFrame, variables: Sequence[str], a: int, row_id: str = "row_id") -> DataFrame:
    """Loadings of a table with fewer rows than variables, as rows (variable, loading_1..A).

    The table is turned on its side (one row per variable, fewer than V columns), so the N x N kernel is an ordinary
    distributed Gram matrix of the turned table and the loadings are a row-local product.  Expects centred columns.
    """
    n = df.count()
    if n >= len(variables):
        raise ValueError(f"{n} rows and {len(variables)} variables: use fit_pca, the dual form is for fewer rows")
    ids = [r[0] for r in df.select(row_id).orderBy(row_id).collect()]  # fewer than V values
    cells = df.select(row_id, F.explode(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(v).alias("value")) for v in variables])).alias("cell"))
    turned = (cells.select(row_id, "cell.variable", "cell.value")
              .groupBy("variable").agg(*[F.max(F.when(F.col(row_id) == i, F.col("value"))).alias(f"r{k}")
                                         for k, i in enumerate(ids)]))
    columns = [f"r{k}" for k in range(n)]
    kernel = sum_stats(turned, {"x": columns}, lambda _, x: (x.T @ x).ravel())[()].reshape(n, n)
    lam, vec = np.linalg.eigh(kernel / (len(variables) - 1))
    vec = vec[:, np.argsort(lam)[::-1][:a]]
    vec = vec / np.sqrt(np.einsum("na,nm,ma->a", vec, kernel, vec))
    names = [f"loading_{i + 1}" for i in range(a)]
    raw = row_map(turned, {"x": columns}, lambda _, x: x @ vec, names).select("variable", *names)
    lead = raw.agg(*[F.max_by(c, F.abs(c)).alias(c) for c in names]).first()
    return raw.select("variable", *[(F.col(c) * F.lit(-1.0 if lead[c] < 0 else 1.0)).alias(c) for c in names])
