"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Boosted shallow trees propose rules (the conditions on the way to each node), a lasso logistic regression keeps few of
them, and the kept rules become one Spark column expression over the statistics columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import row_udf, text_bytes, with_result

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "marks", "symbols", "wide", "stops", "spaces", "distinct_words",
    "distinct_lines", "line_words", "longest_word", "log_lines", "repeated_pairs",
)
SCHEMA = ", ".join(f"{s} double" for s in STATISTICS)

_BYTE_CLASS = {
    "upper": [*range(65, 91)], "digits": [*range(48, 58)], "marks": [*b"!\"'(),-.:;?[]_`{}~"], "symbols": [*b"#*$%&|<>@^+=/\\"],
    "wide": [*range(128, 256)], "stops": [*b".!?"], "spaces": [*b" \t\r\n\x0b\x0c"],
}


def text_statistics(texts: list[bytes]) -> dict:
    """One value per text and statistic; shares are of bytes, an empty text has zeros (and ones for distinct shares)."""
    picks = np.zeros((256, len(_BYTE_CLASS)))
    for j, values in enumerate(_BYTE_CLASS.values()):
        picks[values, j] = 1
    out: dict = {s: [] for s in STATISTICS}
    for data in texts:
        shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ picks / max(len(data), 1)
        words = data.split()
        lines = [x for x in data.split(b"\n") if x]
        n = len(words)
        pairs = len(set(zip(words, words[1:])))
        values = {
            "log_bytes": np.log1p(len(data)), "log_words": np.log1p(n), "word_bytes": sum(map(len, words)) / max(n, 1),
            "distinct_words": len(set(words)) / n if n else 1.0, "distinct_lines": len(set(lines)) / len(lines) if lines else 1.0,
            "line_words": n / max(len(lines), 1), "longest_word": float(max(map(len, words), default=0)),
            "log_lines": np.log1p(len(lines)), "repeated_pairs": 1 - pairs / (n - 1) if n > 1 else 0.0,
        } | dict(zip(_BYTE_CLASS, shares))
        for s in STATISTICS:
            out[s].append(float(values[s]))
    return out


def add_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the statistics of every whole text; a null text counts as empty, same-named columns are replaced."""
    return with_result(docs, row_udf(text_statistics, SCHEMA)(text_bytes(text_col)), list(STATISTICS))


@dataclass(frozen=True)
class Rule:
    """All conditions (statistic, is above, limit) hold; `weight` is added to the log odds."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[Rule, ...]


def _best_split(column: np.ndarray, residual: np.ndarray, curve: np.ndarray, limits: np.ndarray, least: int) -> tuple[float, float]:
    """Gain and limit of the best cut of one statistic, over the given limits."""
    bins = np.searchsorted(limits, column, "left")  # values up to limits[k] are in bins 0..k
    g = np.cumsum(np.bincount(bins, residual, len(limits) + 1))
    h = np.cumsum(np.bincount(bins, curve, len(limits) + 1))
    c = np.cumsum(np.bincount(bins, minlength=len(limits) + 1))
    left_g, left_h, left_c = g[:-1], h[:-1], c[:-1]
    gain = left_g**2 / (left_h + 1) + (g[-1] - left_g) ** 2 / (h[-1] - left_h + 1) - g[-1] ** 2 / (h[-1] + 1)
    gain = np.where((left_c >= least) & (c[-1] - left_c >= least), gain, -1.0)
    k = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[k]), float(limits[k])) if len(gain) else (-1.0, 0.0)


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int, rate: float = 0.3) -> list[tuple]:
    """Conditions on the way to every node of boosted trees, each tree on a random half of the rows and of the statistics."""
    rng = np.random.default_rng(seed)
    limits = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 49))) for j in range(x.shape[1])]
    least = max(5, len(x) // 500)
    odds = np.full(len(x), np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    rules: dict[tuple, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-odds))
        residual, curve = y - p, p * (1 - p)
        rows = np.flatnonzero(rng.random(len(x)) < 0.5)
        columns = np.sort(rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False))
        nodes = [((), rows, np.arange(len(x)))]
        for level in range(depth + 1):
            following = []
            for path, own, every in nodes:
                best = max((_best_split(x[own, j], residual[own], curve[own], limits[j], least) + (j,) for j in columns), default=(-1.0, 0.0, 0)) if level < depth else (-1.0, 0.0, 0)
                if path:
                    rules[path] = None
                if best[0] <= 1e-6:
                    odds[every] += rate * residual[own].sum() / (curve[own].sum() + 1)
                    continue
                _, limit, j = best
                for above in (False, True):
                    step = (STATISTICS[j], above, limit)
                    a, b = x[own, j] > limit, x[every, j] > limit
                    following.append((path + (step,), own[a == above], every[b == above]))
            nodes = following
    return list(rules)


def rule_matrix(x: np.ndarray, rules: list[tuple]) -> np.ndarray:
    at = {s: j for j, s in enumerate(STATISTICS)}
    out = np.ones((len(x), len(rules)))
    for k, path in enumerate(rules):
        for s, above, limit in path:
            out[:, k] *= (x[:, at[s]] > limit) == above
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, max_iter: int, tol: float = 1e-7) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for the mean log loss plus `penalty` times the absolute weights of scaled rules."""
    mean, scale = z.mean(0), z.std(0)
    scale[scale == 0] = 1
    a = np.column_stack([np.ones(len(z)), (z - mean) / scale])
    step = 4 * len(a) / max(np.linalg.eigvalsh(a.T @ a)[-1], 1e-12)
    w = np.zeros(a.shape[1])
    v, t = w, 1.0
    for _ in range(max_iter):
        u = v - step * (a.T @ (1 / (1 + np.exp(-a @ v)) - y) / len(a))
        u[1:] = np.sign(u[1:]) * np.maximum(np.abs(u[1:]) - step * penalty, 0)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = u + (t - 1) / t_next * (u - w)
        done = np.abs(u - w).max() < tol
        w, t = u, t_next
        if done:
            break
    weights = w[1:] / scale
    return float(w[0] - weights @ mean), weights


def fit_ensemble(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 0.002, max_iter: int = 500, seed: int = 7) -> Ensemble:
    """Rules and weights; with one class or no rows there are no rules and the intercept is the smoothed log odds."""
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if len(y) == 0 or y.min() == y.max():
        return Ensemble(prior, ())
    paths = grow_rules(x, y, trees, depth, seed)
    if not paths:
        return Ensemble(prior, ())
    z, first = np.unique(rule_matrix(x, paths), axis=1, return_index=True)  # rules that hold for the same rows count once
    paths = [paths[k] for k in first]
    intercept, weights = lasso_logistic(z, y, penalty, max_iter)
    kept = [Rule(p, float(w)) for p, w in zip(paths, weights) if w != 0]
    return Ensemble(intercept, tuple(sorted(kept, key=lambda r: r.conditions)))


def compile_score(model: Ensemble) -> Column:
    """The ensemble as one expression over the statistics columns: the probability of label 1."""
    odds = F.lit(model.intercept)
    for rule in model.rules:
        holds = F.lit(True)
        for s, above, limit in rule.conditions:
            holds = holds & (F.col(s) > limit if above else F.col(s) <= limit)
        odds = odds + F.when(holds, F.lit(rule.weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def sample_rows(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `max_rows` labelled rows, those with the smallest keyed hash of the id (below a cut, where there are many labels); repeated labels are rows of their own."""
    named = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__y"))
    joined = stats.join(named, F.col(id_col) == F.col("__id")).select("__y", F.xxhash64(F.lit(11), F.col("__id")).alias("__h"), *STATISTICS)
    known = named.count()  # labels only: a bound that lets about twice the wanted rows through before the sort
    if known > 2 * max_rows:
        joined = joined.where(F.col("__h") < int(2**64 * 2 * max_rows / known) - 2**63)
    rows = joined.orderBy("__h", "__y", *STATISTICS).limit(max_rows).toPandas()
    return rows[list(STATISTICS)].to_numpy(float), rows["__y"].to_numpy(float)


def classify(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", threshold: float = 0.3, max_train_rows: int = 20_000, keep_text: bool = True, **fit) -> DataFrame:
    """`docs` with `score` (probability of label 1) and `predicted` (1 at `threshold` or above).

    The model is fitted on the driver from at most `max_train_rows` labelled rows (16 numbers each), picked by a keyed hash
    of the id among rows where `train` holds; everything else covers all rows.  A null text is scored as an empty one, a
    null or unlabelled id is scored but not learned from, null labels are ignored, repeated ids and labels count as often
    as they occur.  Without labels the score is the smoothed prior.  Columns named `score`, `predicted` or like a statistic
    are replaced.  With `keep_text=False` the text is dropped and the statistics are stored once, so the texts are read
    once; with it they are computed twice and the statistics are dropped from the result.
    """
    if keep_text:
        stats = add_statistics(docs.select(id_col, text_col), text_col).drop(text_col)
    else:
        stats = docs = cut_lineage(add_statistics(docs, text_col).drop(text_col))
    known = stats if train is None else stats.where(train)
    x, y = sample_rows(known, labels, id_col, label_col, max_train_rows)
    score = compile_score(fit_ensemble(x, y, **fit))
    scored = add_statistics(docs, text_col) if keep_text else docs
    replaced = [c for c in scored.columns if c.lower() in ("score", "predicted")]
    scored = scored.withColumn("__score", score).drop(*replaced, *STATISTICS)
    return scored.withColumn("score", F.col("__score")).withColumn("predicted", (F.col("__score") >= threshold).cast("int")).drop("__score")
