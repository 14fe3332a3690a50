"""Step B: re-estimate missing and outlying cells with one or all algorithms."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import argmin_rmsecv_by_group, choose_components, press_matrix
from ..operators.gaps import ORDER, impute, impute_mean
from ..operators.impute import ALGORITHMS, Fit, fit, fitted_values
from ..operators.impute.engine import Context
from ..operators.impute.patterns import (Pattern, empty_cells, filled_folds, filled_moments, fold_sums, largest_over_missing, pattern_sums,
                                         patterns_fit, summarise, totals)
from ..operators.keyed import join_groups
from ..operators.matrix import check_driver_size, row_map, sum_stats
from ..operators.moments import fold_moments, with_folds
from ..operators.pca import fit_pca
from ..operators.ordering import spread_small
from ..session import drop, keep

# Fixed default: which temporary imputation each algorithm starts from.
PREFILL = {
    "MI": "interpolation", "Alternating": "mean", "SVDImpute": "interpolation", "PCADA": "interpolation",
    "PPCA": "interpolation", "PPCA-M": "interpolation", "BPCA": "mean", "SVT": "mean", "ALM": "mean", "ALS": "mean",
}


@dataclass
class FillResult:
    algorithm: str
    df: DataFrame | None
    components: dict[tuple, int] = field(default_factory=dict)
    seconds: float = 0.0
    rounds: int = 0
    trace: list[dict] = field(default_factory=list)
    status: str = "ok"
    error: str | None = None
    cached: DataFrame | None = None
    state: Fit | None = None  # what df is made from
    complete: bool = False  # the last choice of components has met every row of df, all filled

    def release(self) -> None:
        """Drop the cached working table; the result is recomputed from the input if it is used again."""
        if self.cached is not None:
            drop(self.cached)


def start_table(df: DataFrame, variables: Sequence[str], prefill: str, order=ORDER, group_cols: Sequence[str] = (),
                max_rows: int | None = None) -> tuple[DataFrame, list[str]]:
    """The working table with prefilled copies of the variables; a mean prefill needs no copies."""
    if prefill == "mean":
        return df, []
    copies = [f"__z_{v}" for v in variables]
    df = df.withColumns({z: F.col(v) for z, v in zip(copies, variables)})
    return spread_small(impute(df, copies, prefill, order, group_cols, max_rows), df.count(), order[1]), copies


def contexts(df: DataFrame, variables: Sequence[str], copies: list[str], components: int | dict,
             group_cols: Sequence[str] = (), seed: int = 0) -> tuple[dict, dict, dict | None]:
    """({group: (mu, sigma)}, {group: Context}, sums by pattern): scaling of the prefilled table and the sums every algorithm starts from,
    which come with those by pattern unless there are too many patterns."""
    v = len(variables)
    filled = copies or list(variables)
    table = df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n_{i}") for i, c in enumerate(variables)],
        *[F.count(c).alias(f"m_{i}") for i, c in enumerate(filled)],
        *[F.avg(c).alias(f"avg_{i}") for i, c in enumerate(filled)],
        *[F.stddev_pop(c).alias(f"sd_{i}") for i, c in enumerate(filled)]).collect()
    check_driver_size(len(table), 64 * v * v)  # the widest statistics: 50 Gram matrices and as many folds
    scale, rows = {}, {}
    for r in table:
        key = tuple(r[c] for c in group_cols)
        empty = [name for i, name in enumerate(variables) if not r[f"n_{i}"]]
        if empty:
            raise ValueError(f"variables without any value{f' in group {key}' if key else ''}: {empty}")
        rows[key] = r["rows"]
        # a mean prefill adds cells without spread
        sigma = np.array([r[f"sd_{i}"] * np.sqrt(r[f"m_{i}"] / r["rows"]) for i in range(v)])
        scale[key] = (np.array([r[f"avg_{i}"] for i in range(v)]), np.where(sigma > 0, sigma, 1.0))

    def kernel(key, x, z=None):
        mu, sigma = scale[key]
        x = (x - mu) / sigma
        o = ~np.isnan(x)
        x0 = np.where(o, x, 0.0)
        z = x0 if z is None else (z - mu) / sigma
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel(), o.sum(axis=0), x0.sum(axis=0), (x0 * x0).sum(axis=0),
                               (x0.T @ x0).ravel()])

    by_pattern = pattern_sums(df, variables, copies, scale, group_cols)
    if by_pattern is None:
        sums = sum_stats(df, {"x": list(variables)} | ({"z": copies} if copies else {}), kernel, group_cols)
    else:
        sums = totals(by_pattern, v)
    out = {}
    for key, vec in sums.items():
        s, g, n_obs, s_obs, ss_obs, g_obs = np.split(vec, np.cumsum([v, v * v, v, v, v]))
        a = components[key] if isinstance(components, dict) else components
        out[key] = Context(rows[key], a, s, g.reshape(v, v), n_obs, s_obs, ss_obs, g_obs.reshape(v, v), seed)
    return scale, out, by_pattern


@dataclass
class Start:
    """A prefilled, cached table with its scaling and sums; algorithms with the same prefill share one."""

    table: DataFrame
    copies: list[str]
    scale: dict
    contexts: dict[tuple, Context]
    sums: dict[tuple, np.ndarray] | None = None  # by group and pattern
    patterns: dict[tuple, dict[int, Pattern]] | None = None
    summarised: bool = False
    folds: dict[tuple, dict | None] = field(default_factory=dict)  # by (n_splits, num_repeat, seed)

    def summary(self, variables: Sequence[str]) -> dict[tuple, dict[int, Pattern]] | None:
        """The rows by pattern of missing cells, for all algorithms that share this table."""
        if not self.summarised:
            self.patterns, self.summarised = summarise(self.sums, list(self.scale), len(variables)), True
        return self.patterns

    def fold_sums(self, variables: Sequence[str], n_splits: int, num_repeat: int, seed: int, row_id: str, group_cols: Sequence[str] = ()) -> dict | None:
        """The rows by pattern and fold, from one pass for all algorithms that share this table; None if these are too many numbers."""
        key = (n_splits, num_repeat, seed)
        if key not in self.folds:
            patterns, self.folds[key] = self.summary(variables), None
            if patterns is not None and patterns_fit(patterns, len(variables), n_splits * num_repeat):
                folded = with_folds(self.table, n_splits, num_repeat, seed, row_id)
                self.folds[key] = fold_sums(folded, variables, self.copies, self.scale, n_splits, num_repeat, group_cols)
        return self.folds[key]


def prepare(df: DataFrame, variables: Sequence[str], prefill: str, components: int | dict, order: Sequence[str] = ORDER,
            group_cols: Sequence[str] = (), seed: int = 0, max_rows: int | None = None) -> Start:
    table, copies = start_table(df, variables, prefill, order, group_cols, max_rows)
    table = keep(table)
    return Start(table, copies, *contexts(table, variables, copies, components, group_cols, seed))


RULES = ("one_se", "argmin")
ROUNDS = ("max_rounds", "n_splits", "num_repeat", "upper", "se_rule", "rule", "warm_start")  # options of the component loop


def _proposal(total, folds, n_splits, upper, se_rule, rule) -> int:
    if rule == "one_se":
        return choose_components(total, folds, n_splits, upper, se_rule)
    return int(press_matrix(total, folds, n_splits, upper).sum(axis=1).argmin()) + 1


def fill_missing(df: DataFrame, variables: Sequence[str], algorithm: str, components: int | dict, *,
                 prefill: str | None = None, order: Sequence[str] = ORDER, group_cols: Sequence[str] = (),
                 n_splits: int = 5, num_repeat: int = 10, upper: int | None = None, se_rule: float = 1.0,
                 rule: str = "one_se", warm_start: bool = True, max_iter: int = 1000, max_rounds: int = 10, seed: int = 0,
                 max_rows: int | None = None, start: Start | None = None, **options) -> FillResult:
    """Fit, fill, choose the number of components again; repeat until that number has been seen before.

    Returns the filled table in original units; observed cells never change.  max_rounds=0 fits once and keeps the number.
    rule='argmin' takes the smallest cross-validation error instead of the one-standard-error rule; warm_start=False
    starts every round from the prefilled table.
    """
    if rule not in RULES:
        raise ValueError(f"rule {rule!r} is not one of {RULES}")
    variables, group_cols = list(variables), list(group_cols)
    if algorithm == "MI":
        if isinstance(components, dict):
            kept = components
        else:
            groups = df.select(*group_cols).distinct().collect() if group_cols else [()]
            kept = {tuple(r): components for r in groups}
        return FillResult("MI", impute_mean(df, variables, group_cols), kept)
    if algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm {algorithm!r} is not one of {['MI', *ALGORITHMS]}")
    method = ALGORITHMS[algorithm](**options)
    start = start or prepare(df, variables, prefill or PREFILL[algorithm], components, order, group_cols, seed, max_rows)
    work, copies, scale = start.table, start.copies, start.scale
    ctx = {k: replace(c) for k, c in start.contexts.items()}
    state = Fit(method, work, variables, group_cols, copies, scale, {k: method.start(c) for k, c in ctx.items()}, row_id=order[1],
                rows={k: c.n for k, c in ctx.items()})
    if method.borrows:
        state.links = method.layout(state, order, seed, max_rows)
    else:
        state.patterns = start.summary(variables)
    chosen = {k: c.a for k, c in ctx.items()}
    proposals: dict[tuple, list[int]] = {k: [] for k in ctx}
    open_groups = set(ctx)
    result = FillResult(algorithm, None, cached=work)
    for round_no in range(1, max(max_rounds, 1) + 1):
        fit(state, max_iter, round_no, open_groups)
        result.rounds = round_no
        if not max_rounds:
            break
        sums = None if state.patterns is None else start.fold_sums(variables, n_splits, num_repeat, seed, order[1], group_cols)
        if sums is None:
            folded = with_folds(fitted_values(state), n_splits, num_repeat, seed, order[1])
            found = fold_moments(folded, variables, n_splits, num_repeat, group_cols, scale, drop_incomplete=True)
        else:
            found = filled_folds(state, sums, n_splits, num_repeat, open_groups, drop_incomplete=True)
        again = {}
        for key in open_groups:
            total, folds = found[key]
            proposal = _proposal(total, folds, n_splits, upper, se_rule, rule)
            proposals[key].append(proposal)
            if chosen[key] in proposals[key]:
                continue
            chosen[key] = proposal
            if method.uses_components:
                c = ctx[key]
                c.a = proposal
                if warm_start:
                    c.s, c.g = total.s, total.g
                again[key] = method.start(c, state.params[key] if warm_start else None)
        state.params.update(again)
        open_groups = set(again)
        if not again:
            result.complete = all(key in found and found[key][0].n == c.n for key, c in ctx.items())
            break
    result.df, result.state = fitted_values(state), state
    result.components, result.seconds, result.trace = chosen, state.seconds, state.trace
    return result


def largest_contribution(filled: DataFrame, original: DataFrame, variables: Sequence[str], a: int | dict,
                         row_id: str = "row_id", group_cols: Sequence[str] = (), versions: Sequence[str] = ()) -> dict[tuple, float]:
    """Per group the largest positive T2 contribution among the cells that were missing.  `versions` are columns that tell fills
    of the same original apart; each version of a group is judged by itself."""
    keys = [*group_cols, *versions]
    models = fit_pca(filled, variables, a, contrib="2D-Chiang", lim_method="2D-Alcala", row_limits=False, group_cols=keys)
    rows = [*group_cols, row_id]
    marks = original.select(*rows, *[F.col(v).isNull().cast("double").alias(f"__m_{v}") for v in variables])
    joined = join_groups(filled, marks, rows, "inner")

    def worst(key, x, m):
        return (models[key].contributions(models[key].scale(x), positive_only=True)[0] * m).max(axis=1)[:, None]

    scored = row_map(joined, {"x": variables, "m": [f"__m_{v}" for v in variables]}, worst, ["__worst"], keys)
    found = scored.groupBy(*keys).agg(F.max("__worst").alias("worst")).collect()
    return {tuple(r[c] for c in keys): r["worst"] for r in found}


CANDIDATE = "als_candidate"


def fill_als(df: DataFrame, variables: Sequence[str], components: int | dict, candidates: int = 5,
             order: Sequence[str] = ORDER, group_cols: Sequence[str] = (), seed: int = 0, prefill: str | None = None,
             max_rows: int | None = None, start: Start | None = None, **options) -> FillResult:
    """Factorisations from several random starts; every group keeps the one whose imputed cells look least unusual.

    The number of the start is one more group column of the fit, so all starts of all groups share every pass, and so do
    the contributions and the final choice of components: the number of jobs depends on neither.  Rows are multiplied
    inside the tasks; the stored table is not.
    """
    group_cols = list(group_cols)
    if CANDIDATE in df.columns:
        raise ValueError(f"the table has a column {CANDIDATE}")
    start = start or prepare(df, variables, prefill or PREFILL["ALS"], components, order, group_cols, seed, max_rows)
    numbers = range(candidates)
    patterns = start.summary(variables)
    each = F.explode(F.array(*[F.lit(c) for c in numbers])).alias(CANDIDATE)
    many = Start(start.table.select("*", each), start.copies, {(*k, c): s for k, s in start.scale.items() for c in numbers},
                 {(*k, c): replace(x, candidate=c) for k, x in start.contexts.items() for c in numbers},
                 None, None if patterns is None else {(*k, c): p for k, p in patterns.items() for c in numbers}, True)
    number = {k: x.a for k, x in many.contexts.items()}
    result = fill_missing(df, variables, "ALS", number, max_rounds=0, order=order, group_cols=[*group_cols, CANDIDATE], seed=seed,
                          max_rows=max_rows, start=many, **options)
    result.cached = start.table
    if patterns is not None:
        return _best_of_patterns(result, start, numbers, variables, number, order[1], group_cols)
    filled = keep(result.df)
    best: dict[tuple, tuple[float, int]] = {}
    for (*key, candidate), worst in largest_contribution(filled, start.table, variables, number, order[1], group_cols, [CANDIDATE]).items():
        best[tuple(key)] = min(best.get(tuple(key), (np.inf, candidates)), (worst, candidate))
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in group_cols] + [T.StructField(CANDIDATE, T.IntegerType())])
    table = df.sparkSession.createDataFrame([(*k, c) for k, (_, c) in best.items()], schema)
    result.df = join_groups(filled, table, [*group_cols, CANDIDATE], "left_semi").drop(CANDIDATE)
    result.trace = [t | {"group": t["group"][:-1]} for t in result.trace if best[t["group"][:-1]][1] == t["group"][-1]]
    result.components = argmin_rmsecv_by_group(result.df, variables, row_id=order[1], group_cols=group_cols)
    return result


def _best_of_patterns(result: FillResult, start: Start, numbers: Sequence[int], variables: Sequence[str], number: dict, row_id: str,
                      group_cols: list[str]) -> FillResult:
    """The rest of `fill_als` where patterns stand for the rows: one pass scores all starts, and only the best one is filled."""
    many = result.state
    models = fit_pca(many.df, variables, number, contrib="2D-Chiang", lim_method="2D-Alcala", row_limits=False,
                     group_cols=many.group_cols, found=filled_moments(many))

    def worst(c, key, x, missing):
        model = models[(*key, numbers[c])]
        return (model.contributions(model.scale(x), positive_only=True)[0] * missing).max(axis=1)

    def only(choice):
        return Fit(many.algorithm, start.table, list(variables), group_cols, start.copies, start.scale,
                   {k: many.params[(*k, choice[k])] for k in start.scale}, row_id=row_id, rows={k: c.n for k, c in start.contexts.items()},
                   patterns=start.patterns)

    found = largest_over_missing([only(dict.fromkeys(start.scale, c)) for c in numbers], worst)
    best = {k: min(zip(values, numbers))[1] for k, values in found.items()}
    result.state = only(best)
    result.df = fitted_values(result.state)
    result.trace = [t | {"group": t["group"][:-1]} for t in result.trace if best[t["group"][:-1]] == t["group"][-1]]
    n_splits, seed = 7, 11  # of `argmin_rmsecv_by_group`
    sums = start.fold_sums(variables, n_splits, 1, seed, row_id, group_cols)
    folds = None if sums is None else filled_folds(result.state, sums, n_splits, 1)
    result.components = argmin_rmsecv_by_group(result.df, variables, n_splits, seed, row_id, group_cols, folds)
    return result


def run_all(df: DataFrame, variables: Sequence[str], components: int | dict, algorithms: Sequence[str] | None = None,
            **options) -> dict[str, FillResult]:
    """Every algorithm in turn; one that fails, or leaves cells empty, is reported and does not stop the others.

    Algorithms with the same prefill share one prefilled, cached table, the pass that sums its folds and the one that counts
    the cells they leave empty.
    """
    results: dict[str, FillResult] = {}
    starts: dict[str, Start] = {}
    uncounted: dict[str, list[str]] = {}
    shared = {k: options[k] for k in ("order", "group_cols", "seed", "max_rows") if k in options}
    for name in algorithms or ["MI", *ALGORITHMS]:
        try:
            method = options.get("prefill") or PREFILL[name]
            if name != "MI" and method not in starts:
                starts[method] = prepare(df, variables, method, components, **shared)
            if name == "ALS":
                passed = {k: v for k, v in options.items() if k not in ROUNDS}
                result = fill_als(df, variables, components, start=starts[method], **passed)
            else:
                result = fill_missing(df, variables, name, components, start=starts.get(method), **options)
            if result.state is not None and result.state.patterns is not None:
                uncounted.setdefault(method, []).append(name)
            elif not result.complete:
                _report(result, result.df.agg(F.sum(sum(F.col(v).isNull().cast("long") for v in variables))).first()[0])
        except Exception as error:  # noqa: BLE001 - the report is the point
            result = FillResult(name, None, status="failed", error=str(error))
        results[name] = result
    for waiting in uncounted.values():
        try:
            for name, empty in zip(waiting, empty_cells([results[name].state for name in waiting])):
                _report(results[name], empty)
        except Exception as error:  # noqa: BLE001
            results.update({name: FillResult(name, None, status="failed", error=str(error)) for name in waiting})
    return results


def _report(result: FillResult, empty: int | None) -> None:
    if empty:
        result.status, result.error = "incomplete", f"{empty} cells left missing"


def status_table(spark, results: dict[str, FillResult]) -> DataFrame:
    return spark.createDataFrame([(k, r.status, r.error, r.rounds) for k, r in results.items()],
                                 "algorithm string, status string, error string, rounds int")


def trace_table(spark, results: dict[str, FillResult]) -> DataFrame:
    """Objective values of every iteration: (algorithm, round, iteration, metric, value)."""
    rows = [(t["algorithm"], t["round"], t["iteration"], t["metric"], t["value"])
            for r in results.values() for t in r.trace]
    return spark.createDataFrame(rows, "algorithm string, round int, iteration int, metric string, value double")
