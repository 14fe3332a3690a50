import numpy as np
from pyspark.sql import functions as F

from rowmend.operators import keyed, moments, outliers
from rowmend.operators.moments import fold_names, pack_folds, unpack_folds, with_folds
from rowmend.operators.inject import MISS_TYPES
from rowmend.plans.grid import experiment_grid

from .helpers import holes, low_rank, names, to_spark


def test_cell_sets_take_as_many_tasks_as_their_rows_need(spark, monkeypatch):
    cells = spark.range(2000).select((F.col("id") % 500).alias("row_id"), F.concat(F.lit("x"), F.col("id") % 4).alias("variable"))
    old, new = cells.filter("row_id % 3 = 0"), cells.filter("row_id % 2 = 0")
    eligible = spark.range(100, 500).select(F.col("id").alias("row_id"))
    labelled = cells.distinct().withColumn("label", F.lit("observed"))

    def found():
        sets = outliers.outlier_sets(old, new, eligible)
        rest = outliers.normal_cells(labelled, sets)
        return sorted(map(tuple, sets.collect())), sorted(map(tuple, rest.collect())), rest.rdd.getNumPartitions()

    small = found()
    monkeypatch.setattr(keyed, "JOIN_ROWS", 20)
    large = found()
    assert large[:2] == small[:2]
    assert large[2] > int(spark.conf.get("spark.sql.shuffle.partitions"))  # it was never more before


def test_packed_folds_are_the_folds(spark):
    df = with_folds(spark.range(300).withColumnRenamed("id", "row_id"), 7, 30, 3)
    stored = df.select("row_id", *[c.alias(n) for n, c in pack_folds(7, 30).items()])
    assert len(stored.columns) < 5
    columns = ["row_id", *fold_names(30)]
    got = unpack_folds(stored, 7, 30).select(*columns)
    assert got.exceptAll(df.select(*columns)).isEmpty() and got.schema == df.select(*columns).schema


def test_outlier_rounds_draw_the_folds_once(spark, monkeypatch):
    x = holes(low_rank(600, 5, 2, 0.1), 0.1)
    x[np.arange(0, 600, 37), 2] += 40
    drawn = []
    monkeypatch.setattr(outliers, "with_folds", lambda *a: drawn.append(1) or moments.with_folds(*a))
    found = outliers.detect_outliers(to_spark(spark, x), names(5), num_repeat=2)
    assert len(found.trace) > 1 and len(drawn) == 1  # one for each round before
    assert not [c for c in found.labelled.columns if c.startswith("__")]


def test_the_grid_keeps_no_table_of_an_earlier_algorithm(spark):
    truth = to_spark(spark, low_rank(200, 4, 2, 0.1))
    tables = spark.sparkContext._jsc.getPersistentRDDs
    before = len(tables())
    options = {"sims": 1, "miss_types": [min(MISS_TYPES)], "components": 1, "with_time": False, "max_iter": 2, "max_rounds": 0, "tol": 0.05}
    found = experiment_grid(truth, names(4), algorithms=["MI", "PPCA", "BPCA"], **options)
    assert {r["algorithm"] for r in found.collect()} == {"MI", "PPCA", "BPCA"}
    assert len(tables()) <= before + 1  # the damaged table; it was two more for each algorithm
