"""Reading observation tables and storing result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MINUTES_PER_DAY = 1440.0
MICROS_PER_DAY = 8.64e10


def to_days(minutes: Column | str) -> Column:
    """Minutes to days."""
    return (F.col(minutes) if isinstance(minutes, str) else minutes) / F.lit(MINUTES_PER_DAY)


def timestamp_to_days(ts: Column | str) -> Column:
    """Timestamp to fractional days since the epoch, read in the session time zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp")) / F.lit(MICROS_PER_DAY)


def decode_sentinel(df: DataFrame, variables: Sequence[str], threshold: float = 900.0) -> DataFrame:
    """Codes such as 999 stand for missing: every value above the threshold becomes NULL."""
    return df.withColumns({v: F.when(F.col(v) <= threshold, F.col(v)) for v in variables})


def decode_code(df: DataFrame, variables: Sequence[str], code: float) -> DataFrame:
    """One code stands for missing: values equal to it become NULL."""
    return df.withColumns({v: F.when(F.col(v) != code, F.col(v)) for v in variables})


def nan_to_null(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    return df.withColumns({v: F.nanvl(F.col(v).cast("double"), F.lit(None).cast("double")) for v in variables})


def read_matrix(spark: SparkSession, path: str, time_col: str | None = None, variables: Sequence[str] | None = None,
                keys: Sequence[str] = (), fmt: str = "parquet", time_unit: str = "days",
                sentinel: float | None = None, above: float | None = None, **options) -> DataFrame:
    """Observation table as (keys..., t DOUBLE in days, variables DOUBLE with NULL for missing).

    Without names, the first non-key column is the time and all other columns are variables.
    `time_unit` is 'days', 'minutes' or 'timestamp'.  Values equal to `sentinel`, and values above `above`, are missing.
    """
    if time_unit not in ("days", "minutes", "timestamp"):
        raise ValueError(f"unknown time_unit {time_unit!r}")
    if fmt == "csv":
        options = {"header": True, **options}
    raw = spark.read.format(fmt).options(**options).load(path)
    free = [c for c in raw.columns if c not in keys]
    time_col = time_col or free[0]
    variables = list(variables or [c for c in free if c != time_col])
    t = F.col(time_col)
    if time_unit == "minutes":
        t = to_days(t.cast("double"))
    elif time_unit == "timestamp":
        t = timestamp_to_days(t)
    df = raw.select(*keys, t.cast("double").alias("t"), *variables)
    df = nan_to_null(df, variables)
    if sentinel is not None:
        df = decode_code(df, variables, sentinel)
    return df if above is None else decode_sentinel(df, variables, above)


RESULT_SCHEMA = T.StructType([
    T.StructField("sim", T.IntegerType()),
    T.StructField("miss_type", T.IntegerType()),
    T.StructField("algorithm", T.StringType()),
    T.StructField("variable", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
])


def write_results(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store a long result table, one folder per kind of missingness."""
    (results.select([F.col(f.name).cast(f.dataType) for f in RESULT_SCHEMA])
     .write.mode(mode).partitionBy("miss_type").parquet(path))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT_SCHEMA).parquet(path).select(*RESULT_SCHEMA.names)
