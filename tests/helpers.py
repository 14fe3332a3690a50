import numpy as np
import pandas as pd


def low_rank(n=600, v=6, rank=2, noise=0.05, seed=1):
    """Planted low-rank table plus noise."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, rank)) @ rng.normal(size=(rank, v)) * 3 + rng.normal(size=(n, v)) * noise
    return x + rng.normal(size=v) * 5


def names(v):
    return [f"x{i + 1}" for i in range(v)]


def to_spark(spark, x, t=None, extra=None, partitions=4):
    x = np.asarray(x, float)
    cols = names(x.shape[1])
    frame = pd.DataFrame(x, columns=cols)
    frame.insert(0, "t", np.arange(len(x), dtype=float) if t is None else t)
    frame.insert(0, "row_id", np.arange(len(x)))
    for k, values in (extra or {}).items():
        frame[k] = values
    rows = [tuple(None if isinstance(c, float) and np.isnan(c) else c for c in r) for r in frame.itertuples(index=False)]
    types = {"row_id": "bigint", "t": "double"}
    schema = ", ".join(f"{c} {types.get(c, 'double' if c in cols else 'bigint')}" for c in frame.columns)
    return spark.createDataFrame(rows, schema).repartition(partitions)


def back(df, cols, key="row_id"):
    """Numpy matrix in row order, NULL as NaN."""
    return df.select(key, *cols).toPandas().sort_values(key)[cols].to_numpy(dtype=float)


def holes(x, share=0.1, seed=3):
    rng = np.random.default_rng(seed)
    out = x.copy()
    out[rng.random(x.shape) < share] = np.nan
    return out
