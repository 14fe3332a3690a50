"""Iterations without a pass over the rows: what a fit has to know of all rows that miss the same cells.

Given which cells of a row are missing, its estimates are an affine function of its values, and its share of the sums of
an iteration is a polynomial of second degree in them.  So the rows of one pattern may be replaced by any weighted points with the same
number, mean and second moments: every iteration, however many there are, gets the sums that the rows would give.  One pass counts and
sums the rows by pattern; the estimates of all rows are read from one affine map a pattern.  For the same reason sums by pattern and fold give
the folds of every filled table: all fits from one start share that pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..matrix import row_map, sum_stats
from ..moments import Moments, fold_names, pack, unpack

PATTERN = "__pattern"
MAX_VARIABLES = 62  # a pattern is one bigint
MAX_NUMBERS = 2_000_000  # the maps of all patterns go to every task; more patterns than that are iterated over the rows


@dataclass
class Pattern:
    """Points that stand for the rows of one pattern, `weight` rows each; after them the origin and the unit vectors, which give the map."""

    weight: float
    points: int
    x: np.ndarray  # NaN where missing
    z: np.ndarray


def observed_code(variables: Sequence[str]) -> Column:
    """The observed cells of a row as the bits of a number."""
    return reduce(lambda a, b: a + b, [
        F.when(F.col(v).isNull() | F.isnan(v), 0).otherwise(1 << i).cast("bigint") for i, v in enumerate(variables)])


def _points(n: float, s: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, float]:
    """Points and the weight of each: together n rows with sum s and second moments g."""
    mean = s / n
    lam, vec = np.linalg.eigh(g / n - np.outer(mean, mean))
    used = lam > 0
    rank = int(used.sum())
    if not rank:
        return mean[None], n
    spread = (vec[:, used] * np.sqrt(rank * lam[used])).T
    return np.concatenate([mean + spread, mean - spread]), n / (2 * rank)


def pattern_sums(df: DataFrame, variables: Sequence[str], copies: Sequence[str], scale: dict,
                 group_cols: Sequence[str] = ()) -> dict[tuple, np.ndarray] | None:
    """{(group, pattern): packed moments of the prefilled rows} in scaled units, or None if there are too many patterns."""
    v = len(variables)
    most = MAX_NUMBERS // (v * (v + 1))
    if v > MAX_VARIABLES:
        return None
    marked = df.withColumn(PATTERN, observed_code(variables))
    if len(scale) * 2 ** v > most and marked.select(*group_cols, PATTERN).distinct().limit(most + 1).count() > most:
        return None

    def kernel(key, x, z=None):
        mu, sigma = scale[key[:-1]]
        u = np.where(np.isnan(x), 0.0 if z is None else (z - mu) / sigma, (x - mu) / sigma)
        return pack(u)

    blocks = {"x": list(variables)} | ({"z": list(copies)} if copies else {})
    return sum_stats(marked, blocks, kernel, [*group_cols, PATTERN])


def observed_of(code: int, v: int) -> np.ndarray:
    return np.array([code >> i & 1 for i in range(v)], bool)


def totals(sums: dict[tuple, np.ndarray], v: int) -> dict[tuple, np.ndarray]:
    """Per group the sums of the prefilled rows and of their observed cells that every algorithm starts from."""
    out: dict[tuple, np.ndarray] = {}
    for (*key, code), vector in sorted(sums.items(), key=repr):
        n, s, g, o = vector[0], vector[1:1 + v], vector[1 + v:].reshape(v, v), observed_of(code, v)
        own = np.concatenate([s, g.ravel(), n * o, np.where(o, s, 0.0), np.where(o, np.diag(g), 0.0), np.where(np.outer(o, o), g, 0.0).ravel()])
        out[tuple(key)] = out.get(tuple(key), 0.0) + own
    return out


def summarise(sums: dict[tuple, np.ndarray] | None, groups: Sequence[tuple], v: int) -> dict[tuple, dict[int, Pattern]] | None:
    """{group: {pattern: points}} in scaled units, or None if there are too many patterns."""
    if sums is None:
        return None
    out: dict[tuple, dict[int, Pattern]] = {key: {} for key in groups}
    for (*key, code), vector in sorted(sums.items(), key=repr):
        points, weight = _points(vector[0], vector[1:1 + v], vector[1 + v:].reshape(v, v))
        z = np.concatenate([points, np.zeros((1, v)), np.eye(v)])
        out[tuple(key)][code] = Pattern(float(weight), len(points), np.where(observed_of(code, v), z, np.nan), z)
    return out


def patterns_fit(patterns: dict[tuple, dict[int, Pattern]], v: int, folds: int) -> bool:
    """Whether the sums of so many folds of every pattern are few enough."""
    return sum(map(len, patterns.values())) * (1 + v + v * v) * folds <= MAX_NUMBERS


def fold_sums(df: DataFrame, variables: Sequence[str], copies: Sequence[str], scale: dict, n_splits: int, num_repeat: int,
              group_cols: Sequence[str] = ()) -> dict[tuple, np.ndarray]:
    """{(group, pattern): packed moments of every fold of every repeat}, in scaled units, of a prefilled table made by `with_folds`."""
    def kernel(key, x, folds, z=None):
        mu, sigma = scale[key[:-1]]
        u = np.where(np.isnan(x), 0.0 if z is None else (z - mu) / sigma, (x - mu) / sigma)
        return np.concatenate([pack(u[folds[:, r] == f]) for r in range(num_repeat) for f in range(n_splits)])

    blocks = {"x": list(variables), "folds": fold_names(num_repeat)} | ({"z": list(copies)} if copies else {})
    return sum_stats(df.withColumn(PATTERN, observed_code(variables)), blocks, kernel, [*group_cols, PATTERN])


def _settled(fit, key: tuple) -> tuple[dict, list[tuple]]:
    """Parameters without the steps already taken, and (code, pattern, x, z, state) of every pattern after these steps."""
    algorithm, params, patterns = fit.algorithm, fit.params[key], fit.patterns[key]
    state = []
    if algorithm.n_state:
        x, z = (np.concatenate([getattr(p, name) for p in patterns.values()]) for name in ("x", "z"))
        steps, stored = fit.replayed.get(key, ([], []))
        history = params["history"]
        if len(steps) > len(history) or any(a is not b for a, b in zip(steps, history)):
            steps, stored = [], []  # a fresh start
        params = {**params, "history": history[len(steps):]}
        state = algorithm.current(params, x, z, stored)
        fit.replayed[key] = (history, state)
        params["history"] = []
    out, at = [], 0
    for code, p in patterns.items():
        out.append((code, p, p.x, p.z if algorithm.needs_filled else None, [s[at:at + len(p.x)] for s in state]))
        at += len(p.x)
    return params, out


def iteration_sums(fit, active: set) -> dict[tuple, np.ndarray]:
    """What one pass over the rows of the active groups would add up."""
    sums = {}
    for key in active:
        params, settled = _settled(fit, key)
        sums[key] = sum(p.weight * fit.algorithm.stats(params, x[:p.points], z if z is None else z[:p.points], [s[:p.points] for s in state])
                        for _, p, x, z, state in settled)
    return sums


def _estimates(fit, key: tuple):
    """(code, pattern, estimates of all cells at its points, at the origin and at the unit vectors) of every pattern."""
    params, settled = _settled(fit, key)
    for code, p, x, z, state in settled:
        yield code, p, fit.algorithm.fill(params, x, z, state)


def _maps(fit) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """{(group, pattern): (base, slopes)}: base + u @ slopes estimates the cells of a row u."""
    return {(*key, code): (found[p.points], found[p.points + 1:] - found[p.points])
            for key in fit.params for code, p, found in _estimates(fit, key)}


def _fill(x: np.ndarray, z: np.ndarray | None, scale: tuple, to: tuple) -> np.ndarray:
    """Rows of one pattern in original units, filled by its map."""
    (mu, sigma), (base, slopes) = scale, to
    missing = np.isnan(x)
    u = np.where(missing, 0.0 if z is None else (z - mu) / sigma, (x - mu) / sigma)
    return np.where(missing, (base + u @ slopes) * sigma + mu, x)


def _row_blocks(fit) -> dict[str, list[str]]:
    return {"x": list(fit.variables)} | ({"z": list(fit.filled_cols)} if fit.filled_cols and fit.algorithm.needs_filled else {})


def filled_rows(fit) -> DataFrame:
    """The table with the estimates of its missing cells in original units."""
    maps, scale = _maps(fit), fit.scale

    def filled(key, x, z=None):
        return _fill(x, z, scale[key[:-1]], maps[key])

    marked = fit.df.withColumn(PATTERN, observed_code(fit.variables))
    return row_map(marked, _row_blocks(fit), filled, fit.variables, [*fit.group_cols, PATTERN])


def filled_moments(fit) -> dict[tuple, Moments]:
    """Moments of the filled table by group; the points have those of the rows."""
    out = {}
    for key in fit.params:
        total, incomplete = 0.0, 0.0
        for _, p, found in _estimates(fit, key):
            y = np.where(np.isnan(p.x), found, p.x)[:p.points]
            if np.isnan(y).any():
                incomplete += p.weight * p.points
            else:
                total = total + p.weight * pack(y)
        if incomplete:
            raise ValueError(f"{round(incomplete)} rows have missing cells; impute them first")
        out[key] = unpack(total, *fit.scale[key])
    return out


def filled_folds(fit, sums: dict[tuple, np.ndarray], n_splits: int, num_repeat: int, groups: set | None = None,
                 drop_incomplete: bool = False) -> dict[tuple, tuple[Moments, list[Moments]]]:
    """What `fold_moments` finds in the filled table: the sums of a pattern go through its map."""
    v = len(fit.variables)
    width, maps, out, incomplete = 1 + v + v * v, _maps(fit), {}, 0.0
    for key in fit.params if groups is None else groups:
        found = np.zeros((num_repeat * n_splits, width))
        for code in fit.patterns[key]:
            base, slopes = maps[(*key, code)]
            through = np.where(observed_of(code, v), np.eye(1 + v)[:, 1:], np.concatenate([base[None], slopes]))
            parts = sums[(*key, code)].reshape(num_repeat * n_splits, width)
            if np.isnan(through).any():
                incomplete += parts[:n_splits, 0].sum()
                continue
            for i, part in enumerate(parts):
                n, s, g = part[0], part[1:1 + v], part[1 + v:].reshape(v, v)
                m = np.block([[np.array([[n]]), s[None]], [s[:, None], g]])
                found[i] += np.concatenate([[n], m[0] @ through, (through.T @ m @ through).ravel()])
        out[key] = unpack(found[:n_splits].sum(axis=0), *fit.scale[key]), [unpack(p, *fit.scale[key]) for p in found]
    if incomplete and not drop_incomplete:
        raise ValueError(f"{round(incomplete)} rows have missing cells; impute them first")
    return out


def empty_cells(fits: Sequence) -> list[int]:
    """How many cells each of several fits of one table leaves empty; one pass fills the rows for all of them."""
    first = fits[0]
    scale, blocks = first.scale, {"x": list(first.variables)} | ({"z": list(first.filled_cols)} if first.filled_cols else {})
    maps = [(_maps(f), "z" in _row_blocks(f)) for f in fits]

    def kernel(key, x, z=None):
        return np.array([np.isnan(_fill(x, z if with_z else None, scale[key[:-1]], to[key])).sum() for to, with_z in maps], float)

    marked = first.df.withColumn(PATTERN, observed_code(first.variables))
    sums = sum_stats(marked, blocks, kernel, [*first.group_cols, PATTERN])
    return [int(n) for n in sum(sums.values(), np.zeros(len(fits)))]


def largest_over_missing(fits: Sequence, score) -> dict[tuple, list[float | None]]:
    """Per group the largest value over its rows of score(number of the fit, group, filled rows, mask of the filled cells), for several fits of one table in one pass."""
    first, names = fits[0], [f"__worst{i}" for i in range(len(fits))]
    scale, maps = first.scale, [_maps(f) for f in fits]

    def worst(key, x, z=None):
        return np.column_stack([score(i, key[:-1], _fill(x, z, scale[key[:-1]], to[key]), np.isnan(x)) for i, to in enumerate(maps)])

    marked = first.df.withColumn(PATTERN, observed_code(first.variables))
    scored = row_map(marked, _row_blocks(first), worst, names, [*first.group_cols, PATTERN])
    found = scored.groupBy(*first.group_cols).agg(*[F.max(n).alias(n) for n in names]).collect()
    return {tuple(r[c] for c in first.group_cols): [r[n] for n in names] for r in found}
