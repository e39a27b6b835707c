"""Exact top-k search by distributed histogram selection.

Every candidate is scored against every query, in cells of a grid of query groups
and candidate blocks, and no score is ever stored.  A first pass counts scores
into up to 1024 equal bins of each query's range (which the lengths of vectors bound);
the bins' sums over all cells name the bin that holds the query's k-th highest score.
The next pass counts that bin at a finer width, and so on until it is one
score wide.  A last pass keeps what is higher, and of what equals the k-th score the
rows of smallest id.

What a cell sends is small: of a query's bins only those from the highest down to where the
cell alone has k scores (the k-th of all is no lower), and at the end less than
k scores and as many ties as are wanted.

Defined cases: vectors take part as `vectors` says; a null id is never the query's
own and comes after other ids; rows that share the query's id are its own; each row is
a candidate for itself, so repeated rows may be returned side by side, and a repeated query row
is asked again; fewer candidates than k are all returned; an empty table has no
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import vectors as V
from quillspark.llm.common import Scratch, groups_for

#: A pass cuts each interval into 1 << BIN_BITS bins at most.
BIN_BITS = 10


def _scores(group: V.Pack, block: V.Pack, strip: slice) -> np.ndarray:
    s = V.products(group.matrix[strip], block.matrix)
    s[V.own(group.list("id")[strip.start : strip.stop], block.list("id"))] = V.NEVER
    return s


def _count(k: int, bins: int, shift: int):
    """Scores of each query in the `bins` parts of its interval, each `1 << shift` wide."""

    def run(group: V.Pack, block: V.Pack) -> Iterator[pa.Table]:
        keys, low = group.array("key"), group.array("low")
        for strip in V.strips(group.n):
            s = _scores(group, block, strip)
            at = (s - low[strip, None]) >> shift
            inside = (at >= 0) & (at < bins) & (s > V.NEVER)
            row, _ = np.nonzero(inside)
            rows = strip.stop - strip.start
            counts = np.bincount(row * bins + at[inside], minlength=rows * bins).reshape(rows, bins)
            above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
            row, held = np.nonzero((counts > 0) & (above < k))
            yield pa.table({"key": keys[strip][row], "bin": held, "n": counts[row, held]})

    return run


def _keep():
    def run(group: V.Pack, block: V.Pack) -> Iterator[pa.Table]:
        keys, low, need = group.array("key"), group.array("low"), group.array("need")
        ids = block.list("id")
        for strip in V.strips(group.n):
            s = _scores(group, block, strip)
            tie = (s == low[strip, None]) & (s > V.NEVER)
            # A block's rows are in the order of id, so the first ties are those of the smallest.
            tie &= np.cumsum(tie, axis=1, dtype=np.int32) <= need[strip, None]
            row, col = np.nonzero((s > low[strip, None]) | tie)
            yield pa.table({"key": keys[strip][row], "vec_id": ids.take(pa.array(col)), "score": s[row, col]})

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block: int = V.BLOCK, group: int = V.GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products, ties to the smaller id."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = scratch.cut(V.flat(vectors, scale, {"asked": F.coalesce(is_query, F.lit(False))}, id_col, vector_col))
    n, asked, longest = rows.agg(F.count("*"), F.count_if("asked"), F.coalesce(F.max("norm2"), F.lit(0.0))).first()
    columns, across = groups_for(n, block), groups_for(asked, group)
    blocks = scratch.cut(V.packs(rows.withColumn("c", V.salted(rows, columns)), ["c"], {}))
    queries = scratch.cut(rows.where("asked").select("key", "id", "kind", "dim", "cells", V.salted(rows, across).alias("r")))
    spread = blocks.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))

    # All scores lie within the product of the greatest lengths.
    bound = int(min(longest, float(V.MOST))) + 1
    bits = max(1, (2 * bound).bit_length())
    state = queries.select("key", F.lit(-bound).cast("bigint").alias("low"), F.lit(k).alias("need"))

    def met(kernel, schema):
        groups = V.packs(queries.join(state, "key"), ["r"], {"id": "bigint", "key": "bigint", "low": "bigint", "need": "int"})
        return V.meet(groups.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))), spread, ["r", "c"], kernel, schema)

    while bits:
        parts = 1 << min(bits, BIN_BITS)
        bits = max(0, bits - BIN_BITS)
        counts = met(_count(k, parts, bits), "key bigint, bin bigint, n bigint").groupBy("key", "bin").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("key").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))
        held = counts.withColumn("upto", upto).join(state, "key").where("upto >= need and upto - n < need")
        held = held.select("key", F.expr(f"low + shiftleft(bin, {bits})").alias("to"), F.expr("int(need - (upto - n))").alias("left"))
        # A query of fewer candidates than k stays at the lowest score.
        state = scratch.cut(state.join(held, "key", "left").select("key", F.coalesce("to", "low").alias("low"), F.coalesce("left", "need").alias("need")))

    found = met(_keep(), "key bigint, vec_id bigint, score bigint").join(queries.select("key", F.col("id").alias("query_id")), "key")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The contract in SQL: all pairs, ranked.
SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
  from v q join v c on c.vec_id is distinct from q.vec_id
  where q.vec_id % 50 = 0
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id nulls last) as integer) as rank, vec_id, score from s
)
select * from r where rank <= 5
"""
