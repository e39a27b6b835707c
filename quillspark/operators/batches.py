"""Greedy batches by two budgets, without one task that sees all rows.

Rows are in the order of a key.  A batch takes rows while it holds fewer than `most` and their cost stays within
`budget` (a first row always fits), so where a batch begins depends on every row before it.  Rows are cut into
blocks of neighbours.  Whatever came before, the first batch that begins in a block begins with one of its first
`most` rows; for each of these a block says at which place of the next block the first batch begins, and how many
begin in the block itself.  These small tables are composed by pointer doubling: after k steps a row leaps 2^k
blocks, so the place and number at which every block begins is known after about log2(blocks) joins.
Then each block numbers its rows by itself.

Defined cases: a null cost counts as 0; rows of equal key are in the order of `id`; an empty table has no batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.retrieval import RANGES
from quillspark.sources.shared import shared_folder

BLOCK = 8192


def numbered(rows: DataFrame, by: str = "id") -> DataFrame:
    """rows with `at`, their number in the order of `by` (whole numbers) from 0, without sorting all of them in one task: equal
    ranges of values are numbered each by itself, and the ranges' counts (RANGES rows) say where each begins."""
    ends = rows.agg(F.min(by).alias("_low"), F.max(by).alias("_high"))
    ranged = rows.crossJoin(F.broadcast(ends)).withColumn("_p", F.expr(f"int(least({RANGES - 1}, floor(({by} - _low) * {RANGES}.0D / (_high - _low + 1))))"))
    base = ranged.groupBy("_p").agg(F.count("*").alias("_c")).withColumn("_base", F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).drop("_c")
    placed = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(by, "id")) - 1).join(F.broadcast(base), "_p")
    return placed.withColumn("at", (F.col("_i") + F.col("_base")).cast("bigint")).select(*rows.columns, "at")


def _next(cost: np.ndarray, most: int, budget: int) -> np.ndarray:
    """Where the batch that begins at each place ends, within the costs given."""
    sums = np.concatenate(([0], np.cumsum(cost)))
    fits = np.searchsorted(sums, sums[:-1] + budget, side="right") - 1
    here = np.arange(len(cost))
    return np.minimum(np.maximum(fits, here + 1), here + most)


def greedy(rows: DataFrame, most: int, budget: int, cost: str = "cost", by: str = "id", block: int = BLOCK) -> DataFrame:
    """id, batch (from 0 in the order of `by`) and place (from 0 within the batch) of rows with id, `by` and `cost`."""
    if most < 1 or most > block:
        raise ValueError("a batch holds one row at least, and no more than a block")
    spark = rows.sparkSession
    root = shared_folder(spark, "batches")

    def cut(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    held = rows.select(F.col("id").cast("bigint").alias("id"), F.col(by).cast("bigint").alias("k"), F.coalesce(F.col(cost).cast("bigint"), F.lit(0)).alias("cost"))
    placed = cut(numbered(held, "k").withColumn("block", F.floor(F.col("at") / block)), "placed")
    blocks = placed.agg(F.max("block")).first()[0]
    if blocks is None:
        return spark.createDataFrame([], "id bigint, batch bigint, place int")
    # A batch that begins in a block may end among the first rows of the next one, so a block sees those as well.
    edge = placed.where((F.col("at") % block < most) & (F.col("block") > 0)).withColumn("block", F.col("block") - 1)
    seen = placed.unionByName(edge)

    def leaps(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        first = int(frame["block"].iloc[0]) * block
        own = int((frame["at"] < first + block).sum())
        nxt = _next(frame["cost"].to_numpy(np.int64), most, budget)[:own]
        # The place in the next block, and the batches that begin here, from the last row back.
        to, count = np.zeros(own, np.int64), np.zeros(own, np.int64)
        for i in range(own - 1, -1, -1):
            j = nxt[i]
            to[i], count[i] = (j - own, 1) if j >= own else (to[j], count[j] + 1)
        n = min(most, own)
        return pd.DataFrame({"block": first // block, "entry": np.arange(n), "to": to[:n], "count": count[:n]})

    step = cut(seen.groupBy("block").applyInPandas(leaps, "block bigint, entry bigint, to bigint, count bigint"), "leap-0")
    steps = [step]
    while 1 << len(steps) <= blocks:
        k = len(steps) - 1
        a, b = steps[k].alias("a"), steps[k].alias("b")
        both = a.join(b, F.expr(f"a.block + {1 << k} = b.block and a.to = b.entry"))
        steps.append(cut(both.selectExpr("a.block", "a.entry", "b.to", "a.count + b.count as count"), f"leap-{k + 1}"))
    known = spark.createDataFrame([(0, 0, 0)], "block bigint, entry bigint, before bigint")
    for k in reversed(range(len(steps))):
        a, b = known.alias("a"), steps[k].alias("b")
        more = a.join(b, ["block", "entry"]).selectExpr(f"block + {1 << k} as block", "to as entry", "before + count as before")
        known = cut(known.unionByName(more.where(F.col("block") <= blocks)), f"known-{k}")

    def numbers(frame: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        first = int(frame["block"].iloc[0]) * block
        own = int((frame["at"] < first + block).sum())
        nxt = _next(frame["cost"].to_numpy(np.int64), most, budget)
        i, batch = int(start["entry"].iloc[0]), int(start["before"].iloc[0])
        number, place = np.full(len(frame), -1, np.int64), np.zeros(len(frame), np.int64)
        while i < own:
            number[i : nxt[i]], place[i : nxt[i]] = batch, np.arange(nxt[i] - i)
            i, batch = nxt[i], batch + 1
        done = number >= 0
        return pd.DataFrame({"id": frame["id"][done], "batch": number[done], "place": place[done]})

    return seen.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(numbers, "id bigint, batch bigint, place int")

