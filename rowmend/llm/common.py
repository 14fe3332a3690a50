"""Small helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, result_folder

BATCH_ROWS = 1000  # texts that a Python task holds at once
BROADCAST_ROWS = 500_000  # rows of a narrow table that may be sent to every task


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches that stay small although texts are long; results don't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as Parquet in the shared folder, read again: narrow columns take far less room there than in a checkpoint."""
    folder = result_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def crc_mod(column: str | Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo `modulus`; a null counts as the empty text."""
    col = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of the text, null as empty: what the row functions below take."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def row_udf(function: Callable[[list], dict], schema: str) -> Callable[..., Column]:
    """Scalar Arrow function over lists of values: `function` gets one list per argument and returns a column of values
    for each field of `schema`; the result is a struct column.  The rest of a row never leaves the JVM."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def many(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for arrays in batches:
            out = function(*(a.to_pylist() for a in arrays))
            yield pa.StructArray.from_arrays([pa.array(out[f.name], f.type) for f in arrow], fields=list(arrow))

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from many((a,) for a in batches)

    def bound(*columns: Column) -> Column:
        if len(columns) == 1:
            one.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
            return F.arrow_udf(one, schema_type(schema))(*columns)
        many.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
        return F.arrow_udf(many, schema_type(schema))(*columns)

    return bound


def schema_type(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def with_result(docs: DataFrame, result: Column, fields: list[str]) -> DataFrame:
    """`docs` with the fields of a struct column added; a column of the same name (case ignored) is replaced."""
    taken = {f.lower() for f in fields}
    hidden = "__result"
    kept = [c for c in docs.columns if c.lower() not in taken]
    quoted = [F.col(f"`{c}`") for c in kept]
    return docs.select(*quoted, result.alias(hidden)).select(*quoted, *(F.col(f"{hidden}.{f}").alias(f) for f in fields))


def code_points(data: bytes) -> int:
    """Code points of valid UTF-8: its bytes but the continuation bytes."""
    return len(data) - len(data.translate(None, _HEADS)) if data else 0


_HEADS = bytes(b for b in range(256) if b & 0xC0 != 0x80)


def byte_table(kept: Callable[[int], bool]) -> bytes:
    """The bytes that `kept` refuses, for bytes.translate(None, ...)."""
    return bytes(b for b in range(256) if not kept(b))


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for each i; empty segments give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def cut_and_count(df: DataFrame) -> tuple[DataFrame, int]:
    """`cut_lineage` and the number of rows, which is counted while they are written."""
    seen = Observation()
    cut = cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return cut, seen.get["n"]


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """A stored, narrow table of `rows` rows, marked for broadcast only if these are at most BROADCAST_ROWS; else Spark shuffles it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def normal_words(column: str) -> Column:
    """The words of a text, A-Z in lower case, joined by single spaces; null as empty."""
    text = F.coalesce(F.col(column), F.lit(""))
    return F.translate(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
