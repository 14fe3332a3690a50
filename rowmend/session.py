"""Session set-up and lineage cutting."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(cores: str = "*", app: str = "rowmend", **conf) -> SparkSession:
    """A local session for tests and benches; a cluster supplies its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the plans made inside; the old values come back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def cut_lineage(df: DataFrame, keep_partitioning: bool = False, partitions: int | None = None) -> DataFrame:
    """Reliable checkpoint in the shared folder the session names; the shuffle files it was made from are freed at once.

    An adaptive plan does not tell the checkpoint how its rows are partitioned.  With `keep_partitioning` this one plan is
    made without adaptive execution, so a table that was hash-partitioned before the cut is not shuffled again after it.  `partitions`
    is the number of shuffle partitions of this plan: a stored table with fewer than the session has would be shuffled again.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="rowmend-checkpoint-")
        sc.setCheckpointDir(folder)
    used = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if keep_partitioning:
        used["spark.sql.adaptive.enabled"] = "false"
    if partitions:
        used["spark.sql.shuffle.partitions"] = str(partitions)
    with settings(spark, used):
        return df.select("*").checkpoint(eager=True)


def result_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for stored tables beside the checkpoints, on storage every executor can reach."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="rowmend-checkpoint-")
    return f"{base.rstrip('/')}/rowmend-{name}-{uuid.uuid4().hex}"


_kept: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Cache a table that several passes read; `release_kept` drops it again.

    Lost blocks are recomputed from lineage, and a released table is recomputed too, so results never depend on it.
    """
    df = df.persist()
    _kept.append(df)
    return df


def drop(df: DataFrame) -> None:
    """Unpersist a kept table and forget it, so that nothing holds the shuffle files it was made from."""
    df.unpersist()
    _kept[:] = [k for k in _kept if k is not df]


def free_files(spark: SparkSession) -> None:
    """Shuffle files and checkpoints of tables that nothing refers to go when the driver collects its garbage, which it may do late by itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release_kept() -> None:
    while _kept:
        _kept.pop().unpersist()
