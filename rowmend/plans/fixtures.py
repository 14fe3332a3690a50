"""Matrices derived from the test tables; every query starts from one of these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import uniform

OM_VARIABLES = ["x1", "x2", "x3", "x4", "x5", "x6"]
# Unit and upper feasibility bound of each order-matrix variable (lower bound 0).
OM_METADATA = [
    ("x1", "pieces", 0.0, 400.0),
    ("x2", "money", 0.0, 650000.0),
    ("x3", "money", 0.0, 30000.0),
    ("x4", "money", 0.0, 25000.0),
    ("x5", "lines", 0.0, 12.0),
    ("x6", "money", 0.0, 1000000.0),
]
PLANTED_FACTOR = 8.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with lines: (row_id, t, x1..x6)."""
    price = F.col("l_extendedprice")
    lines = (table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("x1"),
        F.round(F.sum(price), 2).alias("x2"),
        F.round(F.sum(price * F.col("l_discount")), 4).alias("x3"),
        F.round(F.sum(price * F.col("l_tax")), 4).alias("x4"),
        F.count(F.lit(1)).cast("double").alias("x5")))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("double")
    return (orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
            .select(F.col("o_orderkey").alias("row_id"), day.alias("t"), "x1", "x2", "x3", "x4", "x5",
                    F.round(F.col("o_totalprice") + F.col("x2"), 2).alias("x6")))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many irregular series: (row_id, series, t in microseconds, x)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), F.col("user_id").alias("series"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("x"))


def embedding_matrix(spark: SparkSession, sf_dir: str, width: int = 64) -> tuple[DataFrame, list[str]]:
    """Wide matrix: (row_id, label, e0..e63)."""
    names = [f"e{i}" for i in range(width)]
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), "label",
        *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]), names


def masked(df: DataFrame, variables, level: float = 0.1, seed: int = 42) -> DataFrame:
    """Cells nulled completely at random with portable draws."""
    return df.withColumns({v: F.when(uniform(seed, F.col("row_id"), v) >= level, F.col(v)) for v in variables})


def spiked(df: DataFrame, variables, share: float = 0.002, seed: int = 7) -> DataFrame:
    """Planted outliers: a small share of cells is multiplied by 8."""
    return df.withColumns({
        v: F.when(uniform(seed, F.col("row_id"), v) < share, F.col(v) * PLANTED_FACTOR).otherwise(F.col(v))
        for v in variables})


def variable_metadata(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OM_METADATA, "variable string, unit string, lb double, ub double")
