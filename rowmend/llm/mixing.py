"""Mixing sources to target weights: a subset-sum fit of word budgets over counts of documents by exact length."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BUCKETS = 1024  # parts of a group of equal source and length that are ranked by themselves


def word_count(text_col: str = "text") -> Column:
    """Number of runs of characters other than ASCII white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def reachable(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """Bounded knapsack over exact sums: how many of each size to take, at most counts[i] of sizes[i], so that the sum is
    as large as it can be without passing `capacity`.

    Multiplicities are split into powers of two.  `item` remembers the first piece that reached a sum; a sum's earlier part
    was reached by earlier pieces alone, so walking back never uses a piece twice.  Stops once `capacity` itself is reached.
    """
    taken = np.zeros(len(sizes), np.int64)
    item = np.full(capacity + 1, -1, np.int64)
    item[0] = 0
    pieces: list[tuple[int, int]] = [(0, 0)]
    for i in np.argsort(sizes, kind="stable"):
        size = int(sizes[i])
        left = min(int(counts[i]), capacity // size) if size else 0
        part = 1
        while left > 0 and item[capacity] < 0:
            n = min(part, left)
            left -= n
            part *= 2
            weight = n * size
            new = np.flatnonzero((item[: capacity + 1 - weight] >= 0) & (item[weight:] < 0)) + weight
            item[new] = len(pieces)
            pieces.append((int(i), n))
        if item[capacity] >= 0:
            break
    at = int(np.flatnonzero(item >= 0)[-1])
    while at > 0:
        i, n = pieces[item[at]]
        taken[i] += n
        at -= n * int(sizes[i])
    return taken


def fit_counts(sizes: np.ndarray, counts: np.ndarray, target: float) -> tuple[int, np.ndarray]:
    """Whole repeats of all documents, and how many documents of each size to take once more.

    The rest of the budget is first spread over the sizes in proportion to their counts, so the mix keeps the lengths of
    its source; what rounding leaves over goes to one document more of sizes with the largest remainders (ties in a fixed shuffled order,
    so short ones stay for the end), and the last part
    of it, up to twice the longest document, is fitted exactly by `reachable`.
    """
    total = int((sizes * counts).sum())
    if total == 0:
        return 0, np.zeros(len(sizes), np.int64)
    budget = min(int(round(target)), MOST_COPIES * total)
    repeats, rest = divmod(budget, total)
    exact = counts * (rest / total)
    picked = np.minimum(np.floor(exact * (1 - 1e-12)).astype(np.int64), counts)
    left = rest - int((sizes * picked).sum())
    room = 2 * int(sizes.max())
    ties = np.random.default_rng(len(sizes)).random(len(sizes))
    for i in np.lexsort((ties, picked - exact)):
        if left <= room:
            break
        if sizes[i] and sizes[i] <= left and picked[i] < counts[i]:
            picked[i] += 1
            left -= int(sizes[i])
    if left > 0:
        picked = picked + reachable(sizes, counts - picked, min(left, int((sizes * (counts - picked)).sum())))
    return repeats, picked


def source_targets(sources: DataFrame, source: str, total: str, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, total, target): the sum of all totals shared by weight, none above `most` times its own total.

    Sources in code-point order, a null last, take the weights in turn.  Filling up: in order of total over weight, sources
    are capped as long as the share of the rest still reaches their cap; the others divide what is left by weight.  One row
    a source, ordered in one task: a table as long as the list of sources.
    """
    place = F.row_number().over(W.orderBy(F.col(source).isNull(), source)) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = sources.withColumn("__w", weight).withColumn("__cap", F.col(total) * most)
    order = W.orderBy(F.col("__cap") / F.col("__w"), F.col(source).isNull(), source)
    everything = W.partitionBy()
    before = F.coalesce(F.sum("__cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("__w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    rows = rows.withColumn("__all", F.sum(total).over(everything)).withColumn("__before", before).withColumn("__after", after)
    rows = rows.withColumn("__full", F.col("__cap") * F.col("__after") <= F.col("__w") * (F.col("__all") - F.col("__before")))
    rest = F.col("__all") - F.coalesce(F.sum(F.when(F.col("__full"), F.col("__cap"))).over(everything), F.lit(0))
    share = F.sum(F.when(~F.col("__full"), F.col("__w"))).over(everything)
    target = F.when(F.col("__full"), F.col("__cap").cast("double")).otherwise(F.col("__w") * rest.cast("double") / share)
    return rows.select(source, total, target.alias("target"))


def mix(docs: DataFrame, size: Column, source_col: str = "source", key_cols: Sequence[str] = ("doc_id",), seed: int = 17,
        weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """`docs` with `size`, `source_size`, `target`, and `copies`: how often the mix takes each row (0 to 3).

    Documents of one source and size differ only by a hash of `key_cols` and the seed: those with the smallest hash are
    taken once more than the others.  Rows that agree in the key columns, source and size are interchangeable.  A null
    source is a source of its own, a null size counts as 0; sources without words have target 0 and copies 0.  A large group
    of one source and length is cut by hash and ranked in parts.  Columns named like an output are replaced; an empty table
    gives an empty table.
    """
    outputs = ("size", "source_size", "target", "copies")
    kept = [c for c in docs.columns if c.lower() not in outputs or c == source_col]
    label = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit(""))
    hashed = F.xxhash64(F.lit(seed), *[F.col(c) for c in key_cols])
    rows = docs.withColumn("__size", F.coalesce(size, F.lit(0)).cast("bigint")).withColumn("__s", label).withColumn("__h", hashed)
    rows = rows.select(*[F.col(f"`{c}`") for c in kept], "__size", "__s", "__h", F.shiftrightunsigned("__h", 54).alias("__b"))
    lengths = cut_lineage(rows.groupBy("__s", "__size", "__b").agg(F.count("*").alias("n")))
    by_length = lengths.groupBy("__s", "__size").agg(F.sum("n").alias("n"))
    totals = by_length.groupBy("__s").agg(F.sum(F.col("__size") * F.col("n")).alias("source_size"))
    named = totals.withColumn("__name", F.when(F.col("__s") != "", F.substring("__s", 2, 1 << 30)))
    targets = source_targets(named, "__name", "source_size", weights).withColumn("__s", F.coalesce(F.concat(F.lit("s"), "__name"), F.lit("")))
    targets = cut_lineage(targets.select("__s", "source_size", "target"))

    def fit(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("__size").to_numpy(), kind="stable")
        group = group.take(pa.array(order))
        sizes, counts = group.column("__size").to_numpy(), group.column("n").to_numpy()
        repeats, picked = fit_counts(sizes, counts, group.column("target")[0].as_py())
        repeat = pa.array(np.full(len(sizes), repeats, np.int64))
        return pa.table({"__s": group.column("__s"), "__size": sizes, "__repeats": repeat, "__picked": picked, "source_size": group.column("source_size"), "target": group.column("target")})

    fitted = by_length.join(targets, "__s").groupBy("__s").applyInArrow(
        fit, "__s string, __size bigint, __repeats bigint, __picked bigint, source_size bigint, target double")
    running = F.sum("n").over(W.partitionBy("__s", "__size").orderBy("__b").rowsBetween(W.unboundedPreceding, W.currentRow))
    parts = lengths.withColumn("__before", running - F.col("n")).drop("n").join(fitted, ["__s", "__size"])
    rank = F.row_number().over(W.partitionBy("__s", "__size", "__b").orderBy("__h", *key_cols))
    out = rows.withColumn("__r", rank).join(parts, ["__s", "__size", "__b"])
    extra = (F.col("__before") + F.col("__r") <= F.col("__picked")).cast("bigint")
    copies = F.when(F.col("__size") > 0, F.col("__repeats") + extra).otherwise(F.lit(0)).cast("bigint")
    return out.select(*[F.col(f"`{c}`") for c in kept], F.col("__size").alias("size"), "source_size", "target", copies.alias("copies"))


def expand(mixed: DataFrame) -> DataFrame:
    """A row for every copy that the mix takes, numbered by `copy` from 1."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
