"""PCA by data augmentation: missing cells are the reconstruction plus residuals borrowed from observed cells.

Donors are drawn with replacement from all observed cells of the variable (of the group): the observed cells of a variable
are numbered in the order of the table and a keyed digest gives numbers.  Who borrows from whom never changes during a fit.  So
the table is packed once into blocks of rows that follow each other.  With a block are stored the block each of its donors is in and the
lists of cells that it lends to other blocks, in an order both know: two bytes a donor each.  An iteration then moves bare values: every
block sends one array to each block that borrows from it, the only shuffle of that size, whose files go when the iteration is stored.
What is kept between iterations is the values of the missing cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ...functions.linalg import leading_eigen, orthonormal_average
from ...session import cut_lineage, result_folder
from ..keyed import join_groups
from ..matrix import _floats, check_driver_size, group_rows
from ..ordering import with_position
from .engine import Algorithm, Fit, _light

BLOCK_ROWS = 60_000  # rows of a block at most; a task holds a block and what it borrows
LEAST_ROWS = 500  # a small table is cut into blocks for all cores, but not into smaller ones


def draws(prefix: str, name: str, copies: int, n: int) -> np.ndarray:
    """Numbers below n of the donors of one cell; a digest of (seed, groups, row, variable, pair of copies) holds two."""
    return draws_of([f"{prefix}|{name}"], copies, n)[0]


def draws_of(cells: Sequence[str], copies: int, n: int) -> np.ndarray:
    """The draws of many cells of one variable, a row each."""
    ends = [f"|{k}".encode() for k in range((copies + 1) // 2)]
    out = np.empty((len(cells), copies), np.int64)
    for at in range(0, len(cells), 4096):
        digests = []
        for cell in cells[at:at + 4096]:
            start = md5(cell.encode())
            for end in ends:
                digest = start.copy()
                digest.update(end)
                digests.append(digest.digest())
        words = np.frombuffer(b"".join(digests), ">u4").reshape(-1, 2 * len(ends), 2) / 4294967296.0
        out[at:at + 4096] = np.floor((words[..., 0] + words[..., 1] / 4294967296.0) * n)[:, :copies]
    return out


@dataclass
class Blocks:
    """The packed table (one row a block) and the current values of its missing cells."""

    static: DataFrame  # block, group, keys, rows, x, z, src, to
    state: DataFrame | None  # block, s
    groups: list[tuple]
    key_cols: list[str]
    parts: int  # partitions of `static`, which is dealt by block
    wide: type  # of the stored numbers of blocks
    narrow: type  # of the stored numbers of cells


def _order_of(matrix: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Values of the observed cells, one variable after the other."""
    return matrix.T[mask.T]


def _short(most: int) -> type:
    """The smallest type for numbers up to `most`."""
    return np.uint16 if most < 2 ** 16 else np.uint32


def _slots(src: bytes, wide: type) -> dict[int, np.ndarray]:
    """{block: places of its cells among all borrowed ones}, borrowed cells being in the order of variable, row, copy."""
    of = np.frombuffer(src, wide)
    order = np.argsort(of, kind="stable")
    found = of[order]
    cuts = np.flatnonzero(np.diff(found)) + 1
    return {int(of[part[0]]): part for part in np.split(order, cuts)} if len(of) else {}


def _lent(cells: np.ndarray, starts: np.ndarray, idx: bytes, narrow: type) -> np.ndarray:
    """The wanted ones of the cells of a block: `idx` counts the wanted cells of every variable, then numbers them within their variable."""
    v = len(starts)
    counts = np.frombuffer(idx, np.int32, v)
    return cells[np.repeat(starts, counts) + np.frombuffer(idx, narrow, offset=4 * v)]


def _grams(base: np.ndarray, missing: np.ndarray, borrowed: np.ndarray) -> np.ndarray:
    """Gram matrix of every copy of a block, which differs from the base on missing cells only: G_k = G + D_k'B + B'D_k + D_k'D_k."""
    v = base.shape[1]
    cross, both = np.zeros((2, borrowed.shape[1], v, v))
    ends = np.cumsum(missing.sum(axis=0))
    place = np.cumsum(missing, axis=0) - 1  # of a cell among those of its variable
    part = np.split(borrowed, ends[:-1])
    for i in range(v):
        cross[:, i] = part[i].T @ base[missing[:, i]]
        both[:, i, i] = np.einsum("nk,nk->k", part[i], part[i])
        for j in range(i):
            rows = np.flatnonzero(missing[:, i] & missing[:, j])
            both[:, i, j] = both[:, j, i] = np.einsum("nk,nk->k", part[i][place[rows, i]], part[j][place[rows, j]])
    return base.T @ base + cross + cross.transpose(0, 2, 1) + both


def pack(fit: Fit, order: Sequence[str], copies: int, seed: int, max_rows: int | None = None) -> Blocks:
    """Cut the table into blocks and draw the donors, once per fit.

    The driver holds the number of observed cells of every block and variable, rows / BLOCK_ROWS times V numbers; every task gets
    them to find the block of a donor.
    """
    t, row_id = order
    keys, variables, filled = list(fit.group_cols), list(fit.variables), list(fit.filled_cols)
    names = [f"__key{i}" for i in range(len(keys))]
    spark = fit.df.sparkSession
    table = fit.df.select(*[F.col(c).alias(n) for c, n in zip(keys, names)], F.col(t).alias("__t"), F.col(row_id).alias("__row"),
                          *[F.col(v).alias(f"__x{i}") for i, v in enumerate(variables)], *[F.col(v).alias(f"__z{i}") for i, v in enumerate(filled)])
    sizes = {k: r for k, r in fit.rows.items()}
    size = max(LEAST_ROWS, min(BLOCK_ROWS, math.ceil(sum(sizes.values()) / (2 * spark.sparkContext.defaultParallelism))))
    check_driver_size(sum(math.ceil(r / size) for r in sizes.values()), len(variables))
    placed = with_position(table, ("__t", "__row"), names, "__pos", max_rows)
    placed = cut_lineage(placed.withColumns({
        "__b": F.floor(F.col("__pos") / size), "__name": F.concat_ws("|", F.lit(str(seed)), *[F.col(n).cast("string") for n in [*names, "__row"]])}))
    xs, zs = [f"__x{i}" for i in range(len(variables))], [f"__z{i}" for i in range(len(filled))]
    counted = placed.groupBy(*names, "__b").agg(*[F.count(c).alias(c) for c in xs]).collect()
    counted = sorted((repr(tuple(r)[:len(names)]), r["__b"], tuple(r)[:len(names)], [r[c] for c in xs]) for r in counted)
    groups = list(dict.fromkeys(key for _, _, key, _ in counted))
    number = {key: i for i, key in enumerate(groups)}
    first: dict[tuple, int] = {}
    counts: dict[tuple, list] = {}
    for block, (_, _, key, c) in enumerate(counted):
        first.setdefault(key, block)
        counts.setdefault(key, []).append(c)
    per_block = {key: np.array(c, np.int64) for key, c in counts.items()}
    ends = {key: c.cumsum(axis=0) for key, c in per_block.items()}

    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("group", T.IntegerType())]
                          + [T.StructField(n, placed.schema[n].dataType) for n in names]
                          + [T.StructField("rows", T.ArrayType(placed.schema["__row"].dataType)), T.StructField("x", T.BinaryType()),
                             T.StructField("z", T.BinaryType()), T.StructField("src", T.BinaryType()), T.StructField("idx", T.ArrayType(
                                 T.StructType([T.StructField("src", T.IntegerType()), T.StructField("idx", T.BinaryType())])))])
    arrow = to_arrow_schema(schema)
    wide, narrow = _short(len(counted)), _short(size)

    def one(part: pa.Table) -> pa.Table:
        part = part.combine_chunks().sort_by("__pos")
        key = tuple(part.column(n)[0].as_py() for n in names)
        x = np.column_stack([_floats(part.column(c)) for c in xs])
        missing = np.isnan(x)
        z = np.column_stack([_floats(part.column(c)) for c in zs])[missing] if zs else np.full(int(missing.sum()), np.nan)
        own, end = per_block[key], ends[key]
        prefix = part.column("__name").to_pylist()
        var, row = np.nonzero(missing.T)
        src = np.empty((len(row), copies), np.int64)
        idx = np.empty_like(src)
        for j in set(var.tolist()):
            at = var == j
            drawn = draws_of([f"{prefix[r]}|{variables[j]}" for r in row[at].tolist()], copies, int(end[-1, j]))
            src[at] = np.searchsorted(end[:, j], drawn, side="right")
            idx[at] = drawn - (end[:, j] - own[:, j])[src[at]]
        src = (src.ravel() + first[key]).astype(wide).tobytes()
        idx, of = idx.ravel().astype(narrow), np.repeat(var, copies)
        routes = [{"src": block, "idx": np.bincount(of[at], minlength=len(variables)).astype(np.int32).tobytes() + idx[at].tobytes()}
                  for block, at in _slots(src, wide).items()]
        block = first[key] + int(part.column("__b")[0].as_py())
        values = [[block], [number[key]], *[[k] for k in key], [part.column("__row").to_pylist()], [x.tobytes()], [z.tobytes()], [src], [routes]]
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(values, arrow)], schema=arrow)

    parts = min(len(counted), 20_000) or 1
    packed = placed.groupBy(*names, "__b").applyInArrow(one, schema).repartition(parts, "block")
    packed = cut_lineage(packed, keep_partitioning=True, partitions=parts)
    routes = packed.select(F.col("block").alias("dst"), F.explode("idx").alias("r")).select("dst", F.col("r.src").alias("block"), "r.idx")
    to = routes.repartition(parts, "block").groupBy("block").agg(F.collect_list(F.struct("dst", "idx")).alias("to"))
    static = packed.drop("idx").join(to, "block", "left").sortWithinPartitions("block")
    return Blocks(cut_lineage(static, keep_partitioning=True, partitions=parts), None, groups, names, parts, wide, narrow)


class PCADA(Algorithm):
    name = "PCADA"
    needs_filled = True
    borrows = True
    tolerance = 1e-6

    @property
    def copies(self) -> int:
        return self.options.get("copies", 50)

    def start(self, ctx, previous=None):
        """Without a previous fit the state is the prefilled table, else what the previous fit ended with."""
        return {"cells": ctx.n_obs.sum(), "a": ctx.a, "mse": None, "fresh": previous is None,
                "step": leading_eigen(ctx.correlation(), ctx.a)[1]}

    def update(self, params, sums, last):
        mse = sums[-1] / params["cells"]
        stop = params["mse"] is not None and abs((mse - params["mse"]) / params["mse"]) < self.tolerance
        params["mse"] = mse
        params["fresh"] = False
        if not (stop or last):
            v = params["step"].shape[0]
            params["step"] = orthonormal_average(
                [leading_eigen(g.reshape(v, v), params["a"])[1] for g in np.split(sums[:-1], self.copies)])
        return {"mse_obs": mse}, stop

    def layout(self, fit: Fit, order: Sequence[str], seed: int, max_rows: int | None = None) -> Blocks:
        return pack(fit, order, self.copies, seed, max_rows)

    # -- one iteration ------------------------------------------------------------------------------------------------

    @staticmethod
    def _matrix(sent: Fit, key: tuple, raw: bytes, z: bytes, s: bytes | None):
        """(scaled observed cells with NaN, current scaled values, mask of missing cells) of a block."""
        mu, sigma = sent.scale[key]
        x = (np.frombuffer(raw).reshape(-1, len(mu)) - mu) / sigma
        missing = np.isnan(x)
        now = x.copy()
        if s is not None and not sent.params[key]["fresh"]:
            now[missing] = np.frombuffer(s)
        else:
            first = np.frombuffer(z)
            var = np.nonzero(missing)[1]
            now[missing] = np.where(np.isnan(first), 0.0, (first - mu[var]) / sigma[var])
        return x, now, missing

    def iterate(self, fit: Fit, active: set) -> dict[tuple, np.ndarray]:
        """Sums of the augmented Gram matrices for the active groups; the stored values move one step on."""
        blocks: Blocks = fit.links
        sent, groups, copies, matrix, wide, narrow = _light(fit), blocks.groups, self.copies, self._matrix, blocks.wide, blocks.narrow
        static = blocks.static
        now = static.join(blocks.state, "block", "left") if blocks.state is not None else static.withColumn("s", F.lit(None).cast("binary"))

        def send(batches):
            for batch in batches:
                out = []
                for block, group, x, z, s, to in zip(*(c.to_pylist() for c in batch.columns)):
                    key = groups[group]
                    if key not in active or not to:
                        continue
                    x, at, missing = matrix(sent, key, x, z, s)
                    step = sent.params[key]["step"]
                    cells = _order_of(x - at @ step @ step.T, ~missing)
                    of_variable = (~missing).sum(axis=0)
                    starts = np.cumsum(of_variable) - of_variable
                    out += [(r["dst"], block, _lent(cells, starts, r["idx"], narrow).tobytes()) for r in to]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))],
                                                     names=["dst", "src", "values"])

        lent = now.select("block", "group", "x", "z", "s", "to").mapInArrow(send, "dst int, src int, values binary")
        schema = "block int, group int, s binary, sums array<double>"
        types = (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.float64()))

        def receive(own: pa.Table, got: pa.Table) -> pa.Table:
            out = []
            for block, group, x, z, s, src in zip(*(c.to_pylist() for c in own.columns)):
                key = groups[group]
                if key not in active:
                    if s is not None:
                        out.append((block, group, s, None))
                    continue
                x, at, missing = matrix(sent, key, x, z, s)
                step = sent.params[key]["step"]
                estimate = at @ step @ step.T
                base = np.where(missing, estimate, x)
                var, row = np.nonzero(missing.T)
                borrowed = np.empty(len(var) * copies)
                slots = _slots(src, wide)
                for lender, values in zip(got.column("src").to_pylist(), got.column("values")):
                    borrowed[slots[lender]] = np.frombuffer(values.as_buffer())
                borrowed = borrowed.reshape(-1, copies)  # by variable, then row
                sums = np.append(_grams(base, missing, borrowed).ravel(), np.where(missing, 0.0, (x - estimate) ** 2).sum())
                added = np.zeros(x.shape)
                added.T[missing.T] = borrowed.mean(axis=1) if len(borrowed) else 0.0
                out.append((block, group, (estimate + added)[missing].tobytes(), sums.tolist()))
            columns = list(zip(*out)) or [()] * len(types)
            return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["block", "group", "s", "sums"])

        met = (now.select("block", "group", "x", "z", "s", "src").groupBy("block")
               .cogroup(lent.groupBy("dst")).applyInArrow(receive, schema))
        stepped = cut_lineage(met, partitions=blocks.parts)
        # Spark estimates the size of a join as a product and a checkpoint keeps the estimate; that of files is their size
        folder = result_folder(static.sparkSession, "donors")
        stepped.select("block", "s").write.parquet(folder)
        blocks.state = static.sparkSession.read.parquet(folder)
        few = stepped.select("group", "sums").coalesce(2 * static.sparkSession.sparkContext.defaultParallelism)
        table = few.select("group", F.posexplode("sums").alias("pos", "val")).groupBy("group", "pos").agg(F.sum("val").alias("val")).toArrow()
        out = {}
        for (group,), at in group_rows([table.column("group").combine_chunks()], table.num_rows):
            vector = np.empty(table.num_rows)[at]
            vector[table.column("pos").to_numpy()[at]] = table.column("val").to_numpy()[at]
            out[groups[group]] = vector
        return out

    def filled(self, fit: Fit) -> DataFrame:
        """The last values in original units where a cell is missing."""
        blocks: Blocks = fit.links
        if blocks.state is None:
            return fit.df
        sent, groups, names = _light(fit), blocks.groups, blocks.key_cols
        static, v = blocks.static, len(fit.variables)
        estimates = [f"__e{i}" for i in range(v)]
        schema = T.StructType([static.schema[n] for n in names] + [T.StructField("__row", static.schema["rows"].dataType.elementType)]
                              + [T.StructField(e, T.DoubleType()) for e in estimates])
        arrow = to_arrow_schema(schema)

        def unpack(batches):
            for batch in batches:
                for group, raw, s, rows, *key in zip(*(c.to_pylist() for c in batch.columns)):
                    mu, sigma = sent.scale[groups[group]]
                    x = np.frombuffer(raw).reshape(-1, v)
                    missing = np.isnan(x)
                    at = np.flatnonzero(missing.any(axis=1))
                    if s is None or not len(at):
                        continue
                    full = np.full(x.shape, np.nan)
                    var = np.nonzero(missing)[1]
                    full[missing] = np.frombuffer(s) * sigma[var] + mu[var]
                    columns = [pa.array([k] * len(at), arrow.field(i).type) for i, k in enumerate(key)]
                    columns += [pa.array([rows[i] for i in at.tolist()], arrow.field(len(key)).type)]
                    columns += [pa.array(full[at, j], from_pandas=True) for j in range(v)]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

        found = static.select("block", "group", "x", "rows", *names).join(blocks.state, "block").select("group", "x", "s", "rows", *names).mapInArrow(unpack, schema)
        found = found.select(*[F.col(n).alias(k) for n, k in zip(names, fit.group_cols)], F.col("__row").alias(fit.row_id), *estimates)
        joined = join_groups(fit.df, found, [*fit.group_cols, fit.row_id])
        return joined.withColumns({c: F.coalesce(F.col(c), F.col(e)) for c, e in zip(fit.variables, estimates)}).drop(*estimates)
