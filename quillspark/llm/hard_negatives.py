"""Hard negatives by a Voronoi-partitioned, distributed kNN join.

Vectors get one more component that brings all candidates to the same length (anchors
get 0), so that the highest inner product is the smallest distance.  Pivots part
candidates and anchors into Voronoi cells.  By the triangle inequality the distance from a
candidate to a cell's pivot bounds its distance to each of the cell's anchors, and so
its score: a block of candidates goes to an anchor group only if its partition's
radius allows it, and of the block only the rows that some anchor of the group
might take.  Within a group all scores are exact.

Each of the two joins (an anchor's positives, then the negatives within a band of each
positive's score) has two steps.  The first takes the candidates of the anchors' own
cell, which gives each anchor a first k-th score; the bounds that follow from it choose
what the second step sends.  Bounds are kept per pivot, of which there are at most
`most_pivots`.  Large cells are parted by the rows' own keys into groups and blocks of
bounded size, so copies of one vector don't meet in one task.

Pivots are a bounded sample of the anchors: the `most_pivots` (fewer for few
anchors) of smallest hashed key.  They steer what is sent, not what is found.

Defined cases: vectors take part as `vectors` says, rows without a label don't; a row
is an anchor's own if it has its id; a null id comes after other ids; repeated rows are
candidates each, and repeated anchor rows are each served; an anchor without positives
or negatives has no rows; an empty table has no result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import vectors as V
from quillspark.llm.common import Scratch, groups_for

#: Anchors for each pivot, at least.
ANCHORS_A_PIVOT = 64
#: Distances are doubles; what lies so close to a bound counts as within.
SLACK = 1e-6


class Space:
    """Pivots in the space in which every candidate has the same length."""

    def __init__(self, pivots: np.ndarray, longest2: float):
        self.pivots, self.norms2, self.longest2 = pivots, V.norms2(pivots), longest2
        self.exact = bool(np.isfinite(longest2)) and longest2 < float(1 << 52)

    def nearest(self, m: np.ndarray) -> np.ndarray:
        """Each vector's pivot; the same whether the vector counts as an anchor or a candidate."""
        near = np.zeros(len(m), np.int32)
        if self.exact:
            for strip in V.strips(len(m)):
                near[strip] = np.argmax(2 * self._dots(m[strip]) - self.norms2, axis=1)
        return near

    def _dots(self, m: np.ndarray) -> np.ndarray:
        d = max(m.shape[1], self.pivots.shape[1])
        wide = lambda x: np.pad(x, ((0, 0), (0, d - x.shape[1])))
        return wide(m) @ wide(self.pivots).T

    def distances(self, m: np.ndarray, norms2: np.ndarray | float) -> np.ndarray:
        """To every pivot; `norms2` is that of the whole vectors, with the added component."""
        return np.sqrt(np.maximum(0.0, np.asarray(norms2).reshape(-1, 1) + self.norms2 - 2 * self._dots(m)))


def _placed(rows: DataFrame, space: Space) -> DataFrame:
    """rows with their pivot, and their distance to it as an anchor and as a candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
            m = V.unpacked(col("kind"), col("dim"), col("cells"))
            near = space.nearest(m)
            at = np.arange(len(m))
            if space.exact:
                radius = space.distances(m, V.norms2(m))[at, near]
                reach = space.distances(m, space.longest2)[at, near]
            else:
                radius = reach = np.full(len(m), np.inf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(radius), pa.array(reach)], [*batch.schema.names, "pivot", "radius", "reach"])

    return rows.mapInArrow(run, ", ".join([V.FLAT, "label bigint, anchor boolean, pivot int, radius double, reach double"]))


def _sent(blocks: DataFrame, space: Space, low: np.ndarray, high: np.ndarray, to: list[list[int]]) -> DataFrame:
    """Of each block the rows whose distance to pivot g lies in low[g] .. high[g], for each g in `to` of its own pivot."""
    names = ["g", "j", "c", "n", "kind", "dim", "cells", "id", "labels"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for i, block in enumerate(V.packs_of(table)):
                j, c = table["pivot"][i].as_py(), table["c"][i].as_py()
                if not to[j]:
                    continue
                far = space.distances(block.matrix, space.longest2) if space.exact else None
                for g in to[j]:
                    keep = np.arange(block.n) if far is None else np.flatnonzero(~((far[:, g] < low[g]) | (far[:, g] > high[g])))
                    if len(keep):
                        kind, dim, cells = V.packed(block.matrix[keep])
                        lists = [pa.ListArray.from_arrays(pa.array([0, len(keep)], pa.int32()), block.list(x).take(pa.array(keep))) for x in ("id", "labels")]
                        one = [pa.array([x], t) for x, t in ((g, pa.int32()), (j, pa.int32()), (c, pa.int32()), (len(keep), pa.int32()), (kind, pa.string()), (dim, pa.int32()), (cells, pa.binary()))]
                        yield pa.RecordBatch.from_arrays([*one, *lists], names)

    return blocks.mapInArrow(run, "g int, j int, c int, n int, kind string, dim int, cells binary, id array<bigint>, labels array<bigint>")


def _positives(k: int):
    def run(group: V.Pack, block: V.Pack) -> Iterator[pa.Table]:
        keys, labels, theirs, ids = group.array("key"), group.array("labels"), block.array("labels"), block.list("id")
        for strip in V.strips(group.n):
            s = V.products(group.matrix[strip], block.matrix)
            s[labels[strip, None] != theirs[None, :]] = V.NEVER
            s[V.own(group.list("id")[strip.start : strip.stop], ids)] = V.NEVER
            row, col = np.nonzero(V.first_k(s, k))
            yield pa.table({"key": keys[strip][row], "band": np.zeros(len(row), np.int32), "other": ids.take(pa.array(col)), "score": s[row, col]})

    return run


def _bands(lists: pa.Array, none: int) -> np.ndarray:
    """One end of the bands of each anchor, in a row each; `none` where it has fewer."""
    rows = lists.to_pylist()
    out = np.full((len(rows), max(map(len, rows), default=0)), none, np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _negatives(k: int):
    def run(group: V.Pack, block: V.Pack) -> Iterator[pa.Table]:
        keys, labels, theirs, ids = group.array("key"), group.array("labels"), block.array("labels"), block.list("id")
        low, high = _bands(group.list("low"), 1), _bands(group.list("high"), 0)
        for strip in V.strips(group.n):
            every = V.products(group.matrix[strip], block.matrix)
            every[labels[strip, None] == theirs[None, :]] = V.NEVER
            every[V.own(group.list("id")[strip.start : strip.stop], ids)] = V.NEVER
            for band in range(low.shape[1]):
                s = np.where((every >= low[strip, band, None]) & (every <= high[strip, band, None]), every, V.NEVER)
                row, col = np.nonzero(V.first_k(s, k))
                yield pa.table({"key": keys[strip][row], "band": np.full(len(row), band + 1, np.int32), "other": ids.take(pa.array(col)), "score": s[row, col]})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("key", "band").orderBy(F.desc("score"), F.asc_nulls_last("other")))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


class Join:
    """Anchor groups, candidate blocks, and the two steps of a join between them."""

    def __init__(self, rows: DataFrame, scratch: Scratch, most_pivots: int, block: int, group: int):
        anchors, longest2 = rows.agg(F.count_if("anchor"), F.coalesce(F.max("norm2"), F.lit(0.0))).first()
        few = rows.where("anchor").orderBy(F.xxhash64("key"), "key").limit(max(1, min(most_pivots, anchors // ANCHORS_A_PIVOT)))
        sample = few.select("kind", "dim", "cells").collect()
        pivots = np.unique(V.unpacked(*([r[c] for r in sample] for c in ("kind", "dim", "cells"))), axis=0) if sample else np.zeros((1, 0))
        self.scratch, self.space = scratch, Space(pivots, longest2)
        placed = scratch.cut(_placed(rows, self.space))
        n = len(pivots)
        self.columns, self.parts, self.reach = np.zeros(n, int), np.zeros(n, int), np.zeros(n)
        sizes = placed.groupBy("pivot").agg(F.count("*").alias("n"), F.count_if("anchor").alias("a"), F.max("reach").alias("reach")).collect()
        for r in sizes:
            self.columns[r["pivot"]], self.parts[r["pivot"]], self.reach[r["pivot"]] = groups_for(r["n"], block), -(-r["a"] // group), r["reach"]
        at = lambda values: F.element_at(F.array(*(F.lit(int(max(1, v))) for v in values)), F.col("pivot") + 1)
        self.blocks = scratch.cut(V.packs(placed.withColumn("c", V.salted(placed, at(self.columns))).withColumn("labels", F.col("label")), ["pivot", "c"], {"labels": "bigint"}))
        asking = placed.where("anchor").withColumn("s", V.salted(placed, at(self.parts))).withColumn("labels", F.col("label"))
        self.anchors = scratch.cut(asking)
        with np.errstate(invalid="ignore", over="ignore"):
            # Least distance of a candidate of partition j to pivot g, and the most.
            between = np.sqrt(np.maximum(0.0, V.norms2(pivots)[:, None] + V.norms2(pivots)[None, :] - 2 * pivots @ pivots.T))
            self.least, self.most = between - self.reach[None, :], between + self.reach[None, :]

    def _cells(self, groups: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
        """Each group once for each column of the partitions that its pivot is paired with."""
        spark = groups.sparkSession
        cells = [(g, j, c) for g, j in pairs for c in range(self.columns[j])]
        table = spark.createDataFrame([(g, [(j, int(self.columns[j])) for h, j in pairs if h == g]) for g in sorted({g for g, _ in pairs})], "pivot int, to array<struct<j:int,columns:int>>") if cells else None
        if table is None:
            return groups.where("false").selectExpr("*", "pivot as g", "0 as j", "0 as c")
        out = groups.join(F.broadcast(table), "pivot").select(*groups.columns, F.inline("to"))
        return out.select(F.col("pivot").alias("g"), "*", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("c")).drop("columns")

    def _salts(self, blocks: DataFrame) -> DataFrame:
        """Each block once for each group of its pivot g."""
        parts = F.element_at(F.array(*(F.lit(int(p)) for p in self.parts)), F.col("g") + 1)
        return blocks.where(parts > 0).withColumn("s", F.explode(F.sequence(F.lit(0), parts - 1)))

    def run(self, asking: DataFrame, lists: dict[str, str], kernel, k: int, bounds: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """key, band, other, score, rank: the k first of every band of every anchor."""
        schema = "key bigint, band int, other bigint, score bigint"
        cell = ["g", "s", "j", "c"]
        groups = self.scratch.cut(V.packs(asking, ["pivot", "s"], {"key": "bigint", "labels": "bigint"} | lists))
        n = len(self.parts)
        own = [(g, g) for g in range(n) if self.parts[g] and self.columns[g]]
        near = self._salts(self.blocks.selectExpr("pivot as g", "pivot as j", "c", "n", "kind", "dim", "cells", "id", "labels"))
        first = self.scratch.cut(_best(V.meet(self._cells(groups, own), near, cell, kernel, schema), k))
        low, high = np.full(n, np.inf), np.full(n, -np.inf)
        for r in bounds(first).collect():  # a row for each pivot
            low[r["pivot"]], high[r["pivot"]] = r["low"], r["high"]
        if self.space.exact:
            slack = SLACK * (1 + np.sqrt(self.space.longest2))
            low, high = low - slack, high + slack
        else:  # no bound can be told: every partition is asked
            low, high = np.full(n, -np.inf), np.full(n, np.inf)
        pairs = [(g, j) for g in range(n) for j in range(n) if g != j and self.parts[g] and self.columns[j] and high[g] >= low[g] and not (self.least[g, j] > high[g] or self.most[g, j] < low[g])]
        if not pairs:
            return first
        to: list[list[int]] = [[g for g, j in pairs if j == own_] for own_ in range(n)]
        sent = self._salts(_sent(self.blocks, self.space, low, high, to))
        rest = V.meet(self._cells(groups, pairs), sent, cell, kernel, schema)
        return self.scratch.cut(_best(first.drop("rank").unionByName(rest), k))


def mine(vectors: DataFrame, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90, scale: int = 256,
         id_col: str = "vec_id", vector_col: str = "embedding", most_pivots: int = 256, block: int = V.BLOCK, group: int = V.GROUP) -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its first rows of the same label by score; a positive's negatives the first of another
    label whose score is `low_percent` to `high_percent` of the positive's.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.where(label.isNotNull())
    rows = scratch.cut(V.flat(rows, scale, {"label": label.cast("bigint"), "anchor": F.coalesce(is_anchor, F.lit(False))}, id_col, vector_col))
    join = Join(rows, scratch, most_pivots, block, group)
    longest2 = F.lit(join.space.longest2)
    # Squared distance of an anchor to a candidate of a given score.
    squared = lambda score: F.greatest(F.lit(0.0), F.col("norm2") + longest2 - 2 * score)

    def near(found: DataFrame) -> DataFrame:
        kth = found.where(F.col("rank") == positives).select("key", F.col("score").alias("kth"))
        reach = F.when(F.col("kth").isNull(), F.lit(float("inf"))).otherwise(F.col("radius") + F.sqrt(squared(F.col("kth"))))
        return join.anchors.join(kth, "key", "left").groupBy("pivot").agg(F.lit(0.0).alias("low"), F.max(reach).alias("high"))

    same = join.run(join.anchors, {}, _positives(positives), positives, near)
    # 100 * n >= 30 * p and 100 * n <= 90 * p, in whole numbers of any size; a negative p has no band.
    part = lambda percent, more: F.expr(f"score div 100 * {percent}L + (score % 100 * {percent}L + {more}) div 100")
    bands = same.select("key", F.col("rank").alias("band"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"), part(low_percent, 99).alias("low"), part(high_percent, 0).alias("high"))
    bands = scratch.cut(bands.where("positive_score >= 0"))
    listed = bands.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("band", "low", "high"))).alias("b"))
    asking = scratch.cut(join.anchors.join(listed, "key").select(*join.anchors.columns, F.expr("transform(b, x -> x.low)").alias("low"), F.expr("transform(b, x -> x.high)").alias("high"), F.expr("transform(b, x -> x.band)").alias("band_of")))

    def within(found: DataFrame) -> DataFrame:
        kth = found.where(F.col("rank") == negatives).select("key", "band", F.col("score").alias("kth"))
        of = asking.select("key", "pivot", "radius", "norm2", F.explode(F.arrays_zip("low", "high", "band_of")).alias("x")).select("key", "pivot", "radius", "norm2", F.col("x.band_of").alias("band"), "x.low", "x.high")
        of = of.where("low <= high").join(kth, ["key", "band"], "left")
        return of.groupBy("pivot").agg(F.min(F.sqrt(squared(F.col("high"))) - F.col("radius")).alias("low"), F.max(F.sqrt(squared(F.coalesce("kth", "low"))) + F.col("radius")).alias("high"))

    other = join.run(asking, {"low": "array<bigint>", "high": "array<bigint>"}, _negatives(negatives), negatives, within)
    named = join.anchors.select("key", F.col("id").alias("anchor_id"))
    return other.join(bands.drop("low", "high"), ["key", "band"]).join(named, "key").select(
        "anchor_id", "positive_id", F.col("band").alias("positive_rank"), "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


#: The contract in SQL: all pairs, ranked.
SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, cast(list_dot_product(a.e, c.e) as bigint) as score
  from v a join v c on c.vec_id is distinct from a.vec_id
  where a.vec_id % 100 = 0
), p as (
  select anchor_id, vec_id as positive_id, score as positive_score, cast(row_number() over (partition by anchor_id order by score desc, vec_id nulls last) as integer) as positive_rank
  from s where same
), n as (
  select p.anchor_id, positive_id, positive_rank, cast(row_number() over (partition by p.anchor_id, positive_rank order by score desc, vec_id nulls last) as integer) as rank,
    vec_id as negative_id, positive_score, score as negative_score
  from p join s on s.anchor_id = p.anchor_id and not s.same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
  where positive_rank <= 5
)
select * from n where rank <= 10
"""
