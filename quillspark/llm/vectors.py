"""Vectors of whole numbers: exact inner products, packing, and the meeting of groups with blocks.

Each component x becomes floor(scale * x).  Vectors travel as the bytes of the
smallest kind of number that holds them, packed into blocks of bounded size, and
groups of asking vectors meet blocks in cells of a grid, so that a task holds
one group and a few blocks, whatever the size of either table.

A vector that is null, or has a component that is null or not finite (or is so once
scaled), takes no part.  Shorter vectors count as if zeros followed.  Scores are exact
up to MOST in size; what is larger counts as MOST.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 1 << 61
#: Stands where a row may not be chosen.
NEVER = -(1 << 62)
#: Rows of asking vectors scored at a time.
STRIP = 256
BLOCK, GROUP = 8192, 2048
FLAT = "key bigint, id bigint, kind string, dim int, cells binary, norm2 double"


def whole(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list<double> column take part, and their vectors as a matrix of whole doubles."""
    n = len(column)
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(values * scale)
    row = np.repeat(np.arange(n), np.maximum(lengths, 0))
    good = lengths >= 0
    good[row[~np.isfinite(values)]] = False
    dim = int(lengths.max(initial=0))
    out = np.zeros((n, dim))
    place = np.arange(len(values)) - np.repeat(np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0), np.maximum(lengths, 0))
    out[row, place] = values
    return good, out[good]


def packed(matrix: np.ndarray) -> tuple[str, int, bytes]:
    most = np.abs(matrix).max(initial=0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return kind, matrix.shape[1], matrix.astype(kind).tobytes()


def unpacked(kinds: list[str], dims: list[int], cells: list[bytes]) -> np.ndarray:
    """One matrix of the rows of packed matrices; zeros follow shorter ones."""
    parts = [np.frombuffer(c, k).reshape(-1, d) if d else None for k, d, c in zip(kinds, dims, cells, strict=True)]
    sizes = [1 if p is None else len(p) for p in parts]
    out = np.zeros((sum(sizes), max(dims, default=0)))
    at = 0
    for p, n in zip(parts, sizes, strict=True):
        if p is not None:
            out[at : at + n, : p.shape[1]] = p
        at += n
    return out


def norms2(matrix: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.einsum("ij,ij->i", matrix, matrix)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as int64; no partial sum exceeds the product of the lengths, which chooses the arithmetic."""
    d = max(a.shape[1], b.shape[1])
    a, b = (m if m.shape[1] == d else np.pad(m, ((0, 0), (0, d - m.shape[1]))) for m in (a, b))
    bound = np.sqrt(max(1.0, norms2(a).max(initial=1))) * np.sqrt(max(1.0, norms2(b).max(initial=1)))
    if bound < 1 << 23:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 52:
        return (a @ b.T).astype(np.int64)
    if bound < MOST:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape)
    return np.clip(exact(a) @ exact(b).T, -MOST, MOST).astype(np.int64).reshape(len(a), len(b))


def first_k(scores: np.ndarray, k: int) -> np.ndarray:
    """Mask of each row's k highest scores above NEVER; equal ones by their column."""
    open_ = scores > NEVER
    if scores.shape[1] <= k:
        return open_
    kth = np.partition(scores, -k, axis=1)[:, -k][:, None]
    over = scores > kth
    tie = (scores == kth) & open_
    return over | (tie & (np.cumsum(tie, axis=1, dtype=np.int32) <= k - over.sum(axis=1, keepdims=True)))


def own(asking: pa.Array, ids: pa.Array) -> np.ndarray:
    """Which pairs share an id; null is no id."""
    a, b = (x.to_numpy(zero_copy_only=False) if not x.null_count else pc.fill_null(x, 0).to_numpy(zero_copy_only=False) for x in (asking, ids))
    same = a[:, None] == b[None, :]
    if asking.null_count:
        same[asking.is_null().to_numpy(zero_copy_only=False)] = False
    if ids.null_count:
        same[:, ids.is_null().to_numpy(zero_copy_only=False)] = False
    return same


def flat(vectors: DataFrame, scale: int, more: dict[str, Column], id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector that takes part: key (its own, also where ids repeat), id, the packed vector, its squared length, and `more`."""
    asked = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), *(c.alias(n) for n, c in more.items()))
    extra = asked.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            good, m = whole(batch.column(1), scale)
            if not len(m):
                continue
            rows = batch.filter(pa.array(good))
            parts = [packed(m[i : i + 1]) for i in range(len(m))]
            cols = [pa.array(range(at, at + len(m)), pa.int64()), rows.column(0), *(pa.array(x, t) for x, t in zip(zip(*parts, strict=True), (pa.string(), pa.int32(), pa.binary()), strict=True)), pa.array(norms2(m))]
            at += len(m)
            yield pa.RecordBatch.from_arrays([*cols, *(rows.column(2 + i) for i in range(len(extra)))], ["key", "id", "kind", "dim", "cells", "norm2", *extra])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in asked.schema.fields[2:]]
    return asked.mapInArrow(run, ", ".join([FLAT, *kinds]))


def salted(rows: DataFrame, parts: Column | int) -> Column:
    """A row's number in 0 .. parts - 1, by its own key: equal vectors and ids are spread."""
    return F.pmod(F.xxhash64("key", F.lit("part")), F.lit(parts) if isinstance(parts, int) else parts).cast("int")


def packs(rows: DataFrame, by: list[str], lists: dict[str, str]) -> DataFrame:
    """One row for each group of `by` (whose size the caller has bounded): its vectors as one matrix in the order of id, and `lists` along."""
    keep = ["id", *(c for c in lists if c != "id")]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "n int, kind string, dim int, cells binary", *(f"{c} array<{lists.get(c, 'bigint')}>" for c in keep)])

    def run(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, sort_keys=[("id", "ascending"), ("key", "ascending")])
        table = table.take(order)
        m = unpacked(*(table[c].to_pylist() for c in ("kind", "dim", "cells")))
        kind, dim, cells = packed(m)
        out = {c: table[c].slice(0, 1).combine_chunks() for c in by}
        out |= {"n": pa.array([len(m)], pa.int32()), "kind": pa.array([kind]), "dim": pa.array([dim], pa.int32()), "cells": pa.array([cells], pa.binary())}
        for c in keep:
            values = table[c].combine_chunks()
            out[c] = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.table(out)

    return rows.select(*dict.fromkeys(["key", *by, "kind", "dim", "cells", *keep])).groupBy(*by).applyInArrow(run, schema)


class Pack:
    """A packed row inside a task."""

    def __init__(self, row: dict, table: pa.Table, i: int):
        self.n, self.matrix, self._table, self._i = row["n"], np.frombuffer(row["cells"], row["kind"]).reshape(row["n"], row["dim"]).astype(np.float64), table, i

    def list(self, name: str) -> pa.Array:
        return self._table[name][self._i].values

    def array(self, name: str) -> np.ndarray:
        return self.list(name).to_numpy(zero_copy_only=False)


def packs_of(table: pa.Table) -> Iterator[Pack]:
    small = table.select(["n", "kind", "dim", "cells"])
    for i in range(table.num_rows):
        yield Pack(small.slice(i, 1).to_pylist()[0], table, i)


def meet(groups: DataFrame, blocks: DataFrame, cell: list[str], kernel: Callable[[Pack, Pack], Iterator[pa.Table]], schema: str) -> DataFrame:
    """`kernel` of each group with each block of the same cell; both sides carry the columns of `cell`."""
    empty = groups.sparkSession.createDataFrame([], schema)
    kinds = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in empty.schema.fields])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            for group in packs_of(left):
                for block in packs_of(right):
                    found += kernel(group, block)
        return pa.concat_tables([t.cast(kinds) for t in found]) if found else kinds.empty_table()

    return groups.groupBy(*cell).cogroup(blocks.groupBy(*cell)).applyInArrow(run, schema)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}[kind]


def strips(n: int) -> Iterator[slice]:
    for i in range(0, n, STRIP):
        yield slice(i, min(n, i + STRIP))
