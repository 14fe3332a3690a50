"""The loop shared by all algorithms: row-local statistics on the executors, a V x V step on the driver.

Where the rows have few patterns of missing cells, one pass sums them by pattern and the iterations need no further one
(see `patterns`).  The rest of this text is about tables with too many patterns.  An algorithm never changes the stored table.  Stateless ones (least squares, EM, variational) recompute everything from a
row's observed cells and the current parameters.  The others have per-row state that is itself a function of the row and
the parameters of earlier iterations, so the executors replay those few small matrix products instead of reading a
rewritten table; after REPLAY_LIMIT iterations the state is stored once through a checkpoint and the replay starts afresh.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame

from ...session import cut_lineage
from ..matrix import check_driver_size, row_map, sum_stats
from .patterns import Pattern, filled_rows, iteration_sums

REPLAY_LIMIT = 24


@dataclass
class Context:
    """What an algorithm knows about one matrix before it starts; all values are in scaled units."""

    n: int
    a: int
    s: np.ndarray  # column sums of the filled table
    g: np.ndarray  # Gram matrix of the filled table
    n_obs: np.ndarray
    s_obs: np.ndarray
    ss_obs: np.ndarray
    g_obs: np.ndarray  # Gram matrix with missing cells as 0
    seed: int = 0
    candidate: int = 0  # number of a random start

    @property
    def v(self) -> int:
        return len(self.s)

    def correlation(self) -> np.ndarray:
        mean = self.s / self.n
        cov = self.g / self.n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
        inverse = np.where(sd > 0, 1.0 / np.where(sd > 0, sd, 1.0), 0.0)
        return cov * np.outer(inverse, inverse)

    def total_variance(self) -> float:
        cells = self.n * self.v
        return float(np.trace(self.g) / cells - (self.s.sum() / cells) ** 2)


class Algorithm:
    """Base class; subclasses state what one iteration sums over rows and how it updates the parameters."""

    name = ""
    needs_filled = False  # the kernel reads the filled table as well as the observed cells
    uses_components = True
    n_state = 0  # number of V-wide state matrices per row
    borrows = False  # rows borrow from other rows: the algorithm runs its own passes

    def __init__(self, **options):
        self.options = options

    def start(self, ctx: Context, previous: dict | None = None) -> dict:
        raise NotImplementedError

    def stats(self, params: dict, x: np.ndarray, z: np.ndarray | None, state: list[np.ndarray]) -> np.ndarray:
        raise NotImplementedError

    def update(self, params: dict, sums: np.ndarray, last: bool) -> tuple[dict[str, float], bool]:
        """Change `params` in place; return the metrics of this iteration and whether to stop."""
        raise NotImplementedError

    def fill(self, params: dict, x: np.ndarray, z: np.ndarray | None, state: list[np.ndarray]) -> np.ndarray:
        raise NotImplementedError


class Replayed(Algorithm):
    """An algorithm with per-row state.  `history` are steps already taken, `step` is the one being evaluated."""

    def initial(self, params, x, z) -> list[np.ndarray]:
        raise NotImplementedError

    def advance(self, params, step, x, state) -> list[np.ndarray]:
        raise NotImplementedError

    def current(self, params, x, z, state):
        state = state or self.initial(params, x, z)
        for step in params["history"]:
            state = self.advance(params, step, x, state)
        return state

    @staticmethod
    def commit(params, step):
        params["history"] = [*params["history"], params["step"]]
        params["step"] = step


@dataclass
class Fit:
    """Parameters per group plus the table they refer to."""

    algorithm: Algorithm
    df: DataFrame
    variables: list[str]
    group_cols: list[str]
    filled_cols: list[str]
    scale: dict[tuple, tuple[np.ndarray, np.ndarray]]
    params: dict[tuple, dict]
    state_cols: list[list[str]] = field(default_factory=list)
    trace: list[dict] = field(default_factory=list)
    seconds: float = 0.0
    row_id: str = "row_id"
    links: object | None = None  # of an algorithm that borrows: its packed table and who borrows from whom
    rows: dict[tuple, int] = field(default_factory=dict)  # by group
    patterns: dict[tuple, dict[int, Pattern]] | None = None  # points that stand for the rows; None: iterate over the rows
    replayed: dict[tuple, tuple] = field(default_factory=dict)  # by group: steps taken with the points, their state

    def blocks(self) -> dict[str, list[str]]:
        blocks = {"x": list(self.variables)}
        if self.algorithm.needs_filled and self.filled_cols and not self.state_cols:
            blocks["z"] = list(self.filled_cols)
        for i, cols in enumerate(self.state_cols):
            blocks[f"s{i}"] = cols
        return blocks

    def scaled(self, key, x, z=None, **state):
        mu, sigma = self.scale[key]
        x = (x - mu) / sigma
        if z is not None:
            z = (z - mu) / sigma
        elif self.algorithm.needs_filled and not state:
            z = np.nan_to_num(x, nan=0.0)  # prefilled with the column mean
        return x, z, [state[f"s{i}"] for i in range(len(state))]


def _light(fit: Fit) -> Fit:
    """The same fit without the DataFrame, for shipping to tasks."""
    return Fit(fit.algorithm, None, fit.variables, fit.group_cols, fit.filled_cols, fit.scale, fit.params,
               fit.state_cols)


def store_state(fit: Fit) -> None:
    """Write the current per-row state once and forget the history."""
    sent, algorithm = _light(fit), fit.algorithm
    names = [[f"__state{i}_{v}" for v in fit.variables] for i in range(algorithm.n_state)]

    def now(key, x, z=None, **state):
        x, z, old = sent.scaled(key, x, z, **state)
        return np.column_stack(algorithm.current(sent.params[key], x, z, old))

    df = row_map(fit.df, fit.blocks(), now, [c for cols in names for c in cols], fit.group_cols)
    fit.df = cut_lineage(df)
    fit.state_cols = names
    for params in fit.params.values():
        params["history"] = []


def fit(state: Fit, max_iter: int = 1000, round_no: int = 1, groups: set | None = None) -> Fit:
    """Iterate until every group (of `groups`) has converged or `max_iter` is reached; finished groups do no work."""
    started = time.perf_counter()
    active = set(state.params if groups is None else groups)
    if state.patterns is not None and len(active) > 1 and state.df is not None:
        _fit_apart(state, max_iter, round_no, active)
    else:
        _iterate(state, max_iter, round_no, active)
    state.seconds = time.perf_counter() - started
    return state


def _fit_apart(state: Fit, max_iter: int, round_no: int, groups: set) -> None:
    """Groups whose rows are known by their points need nothing from each other: each is iterated by one task, not one after the other on the driver."""
    sc = state.df.sparkSession.sparkContext
    light = _light(state)

    def one(items):
        for key, params, patterns, replayed in items:
            own = replace(light, params={key: params}, patterns={key: patterns}, replayed={} if replayed is None else {key: replayed}, trace=[])
            _iterate(own, max_iter, round_no, {key})
            yield key, own.params[key], own.replayed.get(key), own.trace

    light.params = {}
    items = [(k, state.params[k], state.patterns[k], state.replayed.get(k)) for k in sorted(groups, key=repr)]
    traces: list[dict] = []
    for key, params, replayed, trace in sc.parallelize(items, min(len(items), 4 * sc.defaultParallelism)).mapPartitions(one).collect():
        state.params[key] = params
        if replayed is not None:
            state.replayed[key] = replayed
        traces += trace
    state.trace += sorted(traces, key=lambda row: (row["iteration"], repr(row["group"])))  # as if all had gone on together


def _iterate(state: Fit, max_iter: int, round_no: int, active: set) -> None:
    algorithm = state.algorithm
    for it in range(max_iter):
        if not active:
            break
        if algorithm.n_state and state.patterns is None and max(len(state.params[k]["history"]) for k in active) >= REPLAY_LIMIT:
            store_state(state)
        sums = _iteration_sums(state, active)
        check_driver_size(len(sums), max((len(v) for v in sums.values()), default=0))
        for key in sorted(active, key=repr):
            params = dict(state.params[key])
            metrics, stop = algorithm.update(params, sums[key], it == max_iter - 1)
            state.params[key] = params
            state.trace += [{"group": key, "algorithm": algorithm.name, "round": round_no, "iteration": it + 1,
                             "metric": m, "value": float(value)} for m, value in metrics.items()]
            if stop:
                active.discard(key)


def _iteration_sums(state: Fit, active: set) -> dict[tuple, np.ndarray]:
    algorithm = state.algorithm
    if algorithm.borrows:
        return algorithm.iterate(state, active)
    if state.patterns is not None:
        return iteration_sums(state, active)
    sent = _light(state)
    sent.params = {k: state.params[k] for k in active}

    def kernel(key, x, z=None, **old):
        if key not in sent.params:
            return np.zeros(0)
        x, z, old = sent.scaled(key, x, z, **old)
        return algorithm.stats(sent.params[key], x, z, old)

    return sum_stats(state.df, state.blocks(), kernel, state.group_cols)


def fitted_values(state: Fit, prefix: str = "") -> DataFrame:
    """The table with every missing cell replaced by its estimate, in original units; observed cells are untouched."""
    algorithm = state.algorithm
    keep = [c for c in state.df.columns if not c.startswith("__")]
    if algorithm.borrows:
        return algorithm.filled(state).select(*keep)
    if state.patterns is not None:
        return filled_rows(state).select(*keep)
    sent = _light(state)

    def filled(key, x, z=None, **old):
        mu, sigma = sent.scale[key]
        scaled, z, old = sent.scaled(key, x, z, **old)
        estimate = algorithm.fill(sent.params[key], scaled, z, old) * sigma + mu
        return np.where(np.isnan(x), estimate, x)

    return row_map(state.df, state.blocks(), filled, state.variables, state.group_cols).select(*keep)
