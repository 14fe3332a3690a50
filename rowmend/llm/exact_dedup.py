"""Exact duplicates by sorting contents: sampled splitters, a sort that can spill, and comparison of neighbours.

Texts are equal when they agree after every run of ASCII white space has become one space.  Rows are dealt out by ranges of
(first bytes, digest, id) of the normalised text, so a text with very many copies is spread over as many ranges as it
needs, and sorted inside each range, where equals are neighbours and are compared byte by byte.  What a border between two
ranges cuts is put together again from at most two runs a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import cut_lineage
from .common import small_batches

PREFIX = 24  # characters of a text in the keys that are sampled for splitters
OUT_ROWS = 50_000  # rows in a batch that goes back to Spark
ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def normal_text(column: str) -> Column:
    """The text with every run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(f"`{column}`"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _runs(schema: pa.Schema):
    """Function over the sorted batches (__id, __rest, __sha, __text) of one range: each row with its run of equal texts."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows, starts, digests = [], [], []
        last = head = tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            text = batch.column(3)
            new = np.ones(batch.num_rows, bool)
            new[0] = last is None or text[0].as_py() != last
            new[1:] = pc.not_equal(text.slice(1), text.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            last = text[batch.num_rows - 1].as_py()
            if head is None:
                head = text[0].as_py()
            if new.any():
                tail = last
            rows.append(batch.select([0, 1]))
            starts.append(new)
            digests.append(batch.column(2).filter(pa.array(new)))
        if not rows:
            return
        table = pa.Table.from_batches(rows).combine_chunks()
        digest = pa.chunked_array(digests)
        new = np.concatenate(starts)
        run = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(new)))
        edges = {first[-1]: tail, 0: head}
        for at in range(0, len(new), OUT_ROWS):
            own = run[at : at + OUT_ROWS]
            piece = table.slice(at, len(own))
            edge = [edges.get(at + i) for i in range(len(own))] if at == 0 or at + len(own) > first[-1] >= at else [None] * len(own)
            columns = [
                pa.array(np.full(len(own), part, np.int32)), pa.array(own.astype(np.int64)), piece.column(0), piece.column(1),
                table.column(0).take(pa.array(first[own])), pa.array(size[own].astype(np.int64)), pa.array(new[at : at + len(own)]),
                digest.take(pa.array(own)), pa.array(edge, pa.string()),
            ]
            merged = pa.Table.from_arrays([pa.chunked_array(c) if isinstance(c, pa.Array) else c for c in columns], names=schema)
            yield from merged.combine_chunks().to_batches()

    return mark


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of `docs` without its text, with the id that stays for its text, the number of equal texts and the digest.

    `keep_id` is the smallest id among equal texts (nulls come last, so it is null only if all are), `group_size` counts
    their rows, `kept` marks the one row that stays, `text_sha256` is the digest of the normalised text.  A null text
    counts as empty.  Of rows that repeat id and text exactly one is kept.  Other columns are carried along; those named like an added column
    are replaced.  An empty table gives an empty table.  A task holds the ids, digests and carried columns of its range,
    never its texts; Spark's sort spills.
    """
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in (id_col, text_col) and c.lower() not in ADDED]
    rest = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others))) if others else F.lit(None).cast("boolean")
    keyed = docs.select(F.col(f"`{id_col}`").alias("__id"), rest.alias("__rest"), normal_text(text_col).alias("__text"))
    keyed = keyed.select("__id", "__rest", F.unhex(F.sha2("__text", 256)).alias("__sha"), "__text")
    keys = [F.substring("__text", 1, PREFIX), F.col("__sha")]
    dealt = keyed.repartitionByRange(*keys, F.asc_nulls_last("__id"))
    ordered = dealt.sortWithinPartitions(*keys, "__text", F.asc_nulls_last("__id"))
    types = dict(zip(keyed.columns, keyed.schema.fields))
    out = (StructType().add("part", "integer").add("run", "long").add("id", types["__id"].dataType).add("rest", types["__rest"].dataType)
           .add("keep", types["__id"].dataType).add("n", "long").add("first", "boolean").add("sha", "binary").add("edge", "string"))
    marked = cut_lineage(ordered.mapInArrow(_runs(out.names), out))

    # only the first and the last run of a range can go on in another range
    edges = marked.where("edge IS NOT NULL").select("part", "run", "keep", "n", "edge")
    whole = edges.groupBy("edge").agg(
        F.count("*").alias("pieces"), F.min("keep").alias("all_keep"), F.sum("n").alias("all_n"),
        F.min(F.struct("part", "run")).alias("front")).where("pieces > 1")
    joined = cut_lineage(edges.join(whole, "edge").select("part", "run", "all_keep", "all_n", (F.struct("part", "run") == F.col("front")).alias("leads")))
    # at most two rows a range, each of a few numbers
    both = marked.join(F.broadcast(joined), ["part", "run"], "left")
    carried = [F.col(f"rest.c{i}").alias(c) for i, c in enumerate(others)]
    return both.select(
        F.col("id").alias(id_col), *carried, F.coalesce("all_keep", "keep").alias("keep_id"), F.coalesce("all_n", "n").alias("group_size"),
        (F.col("first") & F.coalesce("leads", F.lit(True))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row for each text, that of the smallest id; of rows that repeat both id and text any one is left."""
    stays = mark_copies(docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")), "i", "t").where("kept")
    stays = stays.select(F.col("i").alias("__keep_id"), F.col("text_sha256").alias("__keep_sha"))
    own = docs.withColumn("__own_sha", F.sha2(normal_text(text_col), 256))
    found = own.join(stays, (own["__own_sha"] == stays["__keep_sha"]) & own[f"`{id_col}`"].eqNullSafe(stays["__keep_id"]), "left_semi")
    return found.dropDuplicates(["__own_sha"]).select(*(F.col(f"`{c}`") for c in docs.columns))
