"""Choosing rows, columns and cells, and keeping track of what each cell is.

Labels are columns `label_<variable>` next to the values, so relabelling and row-quality rules stay row-local; `to_cells`
gives the long form (one row per cell) for reports.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OBSERVED, MISSING, OUTLIER = "observed", "missing", "outlier"
REMOVED, IMPUTED, REPLACED = "removed", "imputed", "replaced"


def label(v: str) -> str:
    return f"label_{v}"


def select_variables(df: DataFrame, variables: Sequence[str], mask: Sequence[bool], keep: Sequence[str] = ()) -> DataFrame:
    """Keep the variables whose mask entry is true, plus the key columns `keep`."""
    if len(mask) != len(variables):
        raise ValueError(f"mask has {len(mask)} entries for {len(variables)} variables")
    return df.select(*keep, *[v for v, m in zip(variables, mask) if m])


def filter_observations(df: DataFrame, condition: Column | str) -> DataFrame:
    return df.filter(condition)


def align_metadata(metadata: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Rows of the variable dimension (name, unit, bounds) that describe kept variables."""
    return metadata.filter(F.col("variable").isin(list(variables)))


def missing_mask(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Replace every variable by 1 where it is missing, else 0."""
    return df.withColumns({v: F.col(v).isNull().cast("int") for v in variables})


def label_missing(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    return df.withColumns({label(v): F.when(F.col(v).isNull(), MISSING).otherwise(OBSERVED) for v in variables})


def null_outliers(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    return df.withColumns({v: F.when(F.col(label(v)) != OUTLIER, F.col(v)) for v in variables})


def relabel(df: DataFrame, variables: Sequence[str], mapping: Mapping[str, str]) -> DataFrame:
    """Rename labels, e.g. {outlier: missing} between rounds or {missing: imputed, outlier: replaced} before refilling."""
    def renamed(c: Column) -> Column:
        return reduce(lambda acc, kv: acc.when(c == kv[0], kv[1]), mapping.items(), F).otherwise(c)

    return df.withColumns({label(v): renamed(F.col(label(v))) for v in variables})


def n_observed(variables: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [(F.col(label(v)) == OBSERVED).cast("int") for v in variables])


def label_low_quality(df: DataFrame, variables: Sequence[str], min_elements: int = 5) -> DataFrame:
    """All cells of a row with fewer than `min_elements` observed cells become 'removed'."""
    poor = n_observed(variables) < min_elements
    return df.withColumns({label(v): F.when(poor, REMOVED).otherwise(F.col(label(v))) for v in variables})


def drop_low_quality(df: DataFrame, variables: Sequence[str], min_elements: int = 5) -> DataFrame:
    return df.filter(n_observed(variables) >= min_elements)


def unprotected(t: Column | str, t0: float = 10000 / 1440) -> Column:
    """True for rows that may be called outliers: later than the protected period (in days)."""
    return (F.col(t) if isinstance(t, str) else t) > F.lit(t0)


def split_all_missing_rows(df: DataFrame, variables: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with at least one value, rows without any)."""
    some = reduce(lambda a, b: a | b, [F.col(v).isNotNull() for v in variables])
    return df.filter(some), df.filter(~some)


def merge_imputed(df: DataFrame, variables: Sequence[str], estimate: Mapping[str, str]) -> DataFrame:
    """Missing cells take the estimate, observed cells stay."""
    return df.withColumns({v: F.coalesce(F.col(v), F.col(estimate[v])) for v in variables})


def project_observed(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Observed cells stay, missing cells become 0: the projection that matrix completion iterates on."""
    return df.withColumns({v: F.coalesce(F.col(v), F.lit(0.0)) for v in variables})


def to_cells(df: DataFrame, variables: Sequence[str], keys: Sequence[str], with_labels: bool = True) -> DataFrame:
    """Long form (keys..., variable, value[, label]) without a shuffle."""
    entries = []
    for v in variables:
        fields = [F.lit(v).alias("variable"), F.col(v).alias("value")]
        if with_labels:
            fields.append(F.col(label(v)).alias("label"))
        entries.append(F.struct(*fields))
    return df.select(*keys, F.explode(F.array(*entries)).alias("cell")).select(*keys, "cell.*")
