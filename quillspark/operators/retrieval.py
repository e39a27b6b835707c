"""Exact cosine retrieval, suppression of near repeats, budgets, and audits of a vector index."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.slices import give_back
from quillspark.functions.strings import text_hash, word_tokens
from quillspark.functions.vectors import norm

#: Queries and points that meet in one task, and queries scored at a time.
QUERIES, POINTS, STRIP = 2048, 16384, 64


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows (zeros follow shorter ones) and their lengths; one that is null or holds a null has none, so that it is like nothing."""
    whole = pc.all(pc.is_valid(column)).as_py() is not False
    flat = pc.list_flatten(column) if whole else None
    widths = pc.unique(pc.list_value_length(column)).to_pylist()
    if whole and not flat.null_count and len(widths) == 1:  # as nearly all are: no Python number is made
        out = flat.to_numpy().astype(float).reshape(len(column), widths[0])
        return out, np.sqrt(np.einsum("ij,ij->i", out, out))
    rows = column.to_pylist()
    out = np.zeros((len(rows), max((len(r) for r in rows if r), default=0)))
    whole = np.ones(len(rows), bool)
    for i, r in enumerate(rows):
        whole[i] = r is not None and None not in r
        if r:
            out[i, : len(r)] = [0.0 if x is None else x for x in r]
    return out, np.where(whole, np.sqrt(np.einsum("ij,ij->i", out, out)), 0.0)


def knn(points: DataFrame, queries: DataFrame, k: int, min_score: float = -1.0, exclude_self: bool = False) -> DataFrame:
    """query_id, id, rank, score: the k points of highest cosine of each query, ties (to six places) by id.

    The queries are a stated set and go to all points, exactly: groups of queries meet blocks of points in the cells of a grid, so
    that a task holds one of each, the plan is the same for any number of queries, and each cell sends k rows a query
    at most.  A group goes to every block and a block to every group; nothing is broadcast.
    """
    groups, blocks = max(1, -(-queries.count() // QUERIES)), max(1, -(-points.count() // POINTS))
    part = lambda c, n: F.pmod(F.xxhash64(c, F.lit("part")), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("query_id", F.col("query").cast("array<double>").alias("query"), part("query_id", groups).alias("g")).withColumn("b", every(blocks))
    right = points.select("id", F.col("embedding").cast("array<double>").alias("embedding"), part("id", blocks).alias("b")).withColumn("g", every(groups))
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((left, "query_id"), (right, "id"))}

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        names, ids = asked["query_id"].combine_chunks(), held["id"].combine_chunks()
        out = [pa.table({"query_id": names.slice(0, 0), "id": ids.slice(0, 0), "score": pa.array([], pa.float64())})]
        if len(names) and len(ids):
            order = pc.sort_indices(ids)
            ids = ids.take(order)
            (a, an), (m, mn) = _matrix(asked["query"]), _matrix(held["embedding"].take(order))
            width = max(a.shape[1], m.shape[1])
            a, m = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, m))
            same = pc.index_in(names, ids).to_numpy(zero_copy_only=False) if exclude_self else None
            for at in range(0, len(a), STRIP):
                strip = slice(at, at + STRIP)
                length = an[strip, None] * mn[None, :]
                s = np.divide(a[strip] @ m.T, length, out=np.zeros_like(length), where=length > 0)
                shown = np.where(np.round(s, 6) >= min_score, np.round(s, 6), -np.inf)
                if exclude_self:
                    for i, j in enumerate(same[strip]):
                        if j == j and j is not None:
                            j = int(j)
                            while j < len(ids) and ids[j] == names[at + i]:  # in the order of ids repeats are neighbours
                                shown[i, j] = -np.inf
                                j += 1
                # Points are in the order of id: of equal ones the first are the smallest.
                if shown.shape[1] > k:
                    kth = np.partition(shown, -k, axis=1)[:, -k][:, None]
                    over, tie = shown > kth, shown == kth
                    shown[~(over | (tie & (np.cumsum(tie, axis=1) <= k - over.sum(axis=1, keepdims=True))))] = -np.inf
                row, col = np.nonzero(shown > -np.inf)
                out.append(pa.table({"query_id": names.take(pa.array(at + row)), "id": ids.take(pa.array(col)), "score": s[row, col]}))
        give_back()
        return pa.concat_tables(out)

    pairs = left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(best, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
    pairs = pairs.withColumn("score", F.round("score", 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "rank", "score")


def dedupe(matches: DataFrame) -> DataFrame:
    """Matches of each query, best first, without neighbours of a kept chunk and repeated texts of the same document.

    Input: query_id, id, document_id, chunk_index, radius, score, text, kind; summaries are exempt.  Texts are
    the same when they agree but for white space; empty ones repeat nothing.
    The choice depends on its own earlier choices, so each query's bounded list is one group.
    """

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True], kind="stable")
        places: dict = {}
        texts: set = set()
        kept = []
        for r in rows.itertuples():
            if r.kind != "summary":
                near = places.setdefault(r.document_id, [])
                folded = (r.document_id, " ".join((r.text or "").split()))
                if folded in texts or any(abs(r.chunk_index - i) <= max(r.radius, radius, 1) for i, radius in near):
                    continue
                near.append((r.chunk_index, r.radius))
                if folded[1]:
                    texts.add(folded)
            kept.append(r.Index)
        return rows.loc[kept, ["query_id", "id", "score"]]

    return matches.groupBy("query_id").applyInPandas(keep, "query_id bigint, id bigint, score double")


def fit(ranked: DataFrame, budget: int, text: str = "text") -> DataFrame:
    """The longest prefix of each query's list, by rank, whose tokens fit the budget."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    used = ranked.withColumn("used", F.sum(word_tokens(F.col(text))).over(w))
    return used.where(F.col("used") <= budget)


def norms(points: DataFrame) -> DataFrame:
    n = points.select(norm("embedding").alias("n"))
    return n.agg(
        F.round(F.min("n"), 6).alias("low"),
        F.round(F.median("n"), 6).alias("median"),
        F.expr("round(percentile_disc(0.95) within group (order by n), 6)").alias("p95"),
        F.round(F.max("n"), 6).alias("high"),
    )


def identical(points: DataFrame) -> DataFrame:
    """Groups of vectors that agree to six places though their texts (by `text_hash`) differ."""
    key = F.sha2(F.concat_ws(",", F.transform("embedding", lambda x: F.format_number(x.cast("double"), 6))), 256)
    return points.groupBy(key.alias("k")).agg(F.count("*").alias("points"), F.count_distinct("text_hash").alias("texts"), F.min("id").alias("first_id")).where("texts > 1").drop("k")


def agreement(neighbours: DataFrame, points: DataFrame) -> DataFrame:
    """How often a point's nearest neighbour is of its own document, and the mean score of those that aren't."""
    own = points.select(F.col("id").alias("query_id"), F.col("document_id").alias("own"))
    near = points.select("id", F.col("document_id").alias("other"))
    rows = neighbours.where("rank = 1").join(own, "query_id").join(near, "id")
    return rows.agg(
        F.count("*").alias("sampled"),
        F.round(F.count_if(F.col("own") == F.col("other")) / F.greatest(F.count("*"), F.lit(1)), 6).alias("share_own"),
        F.round(F.avg(F.when(F.col("own") != F.col("other"), F.col("score"))), 5).alias("mean_other"),
    )


def duplicates(documents: DataFrame, least_tokens: int = 8) -> DataFrame:
    """Groups of documents of one folded text."""
    long = documents.where(word_tokens(F.col("text")) >= least_tokens)
    return long.groupBy(text_hash(F.col("text")).alias("hash")).agg(F.count_distinct("doc_id").alias("documents"), F.min("doc_id").alias("first_id")).where("documents > 1")


def rank(value: str, share: float) -> Column:
    """The `value` at a share of `n` rows, of which `upto` have it or a smaller one, by the half-even rule."""
    return F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.bround(F.lit(share) * F.col("n"))), F.col(value)))


def distribution(chunks: DataFrame, size: int) -> DataFrame:
    """Token counts of chunks; percentiles by the half-even rank rule: element max(1, round(p * n))."""
    # Counts go through a histogram, so that no task holds one value per chunk.
    hist = chunks.groupBy("token_count").agg(F.count("*").alias("c"))
    run = hist.withColumn("upto", F.sum("c").over(Window.orderBy("token_count"))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    return run.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("chunks"),
        F.min("token_count").alias("low"),
        rank("token_count", 0.5).alias("median"),
        rank("token_count", 0.95).alias("p95"),
        F.max("token_count").alias("high"),
        F.coalesce(F.sum(F.when(F.col("token_count") >= int(0.9 * size), F.col("c"))), F.lit(0)).alias("at_ceiling"),
    )


def histogram(chunks: DataFrame, size: int, buckets: int = 12) -> DataFrame:
    """Chunks by token count in equal buckets up to 1.5 sizes, the last one open; empty buckets count 0."""
    width = -(-(3 * size) // (2 * buckets))
    counts = chunks.groupBy(F.least(F.lit(buckets - 1), F.floor(F.col("token_count") / width)).cast("int").alias("bucket")).agg(F.count("*").alias("c"))
    every = chunks.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", (F.col("bucket") * width).alias("low"), F.coalesce("c", F.lit(0)).alias("chunks"))


def outliers(documents: DataFrame, factor: float = 3.0, least: int = 5, shown: int = 10) -> DataFrame:
    """The `shown` documents of each connector whose chunks a kilobyte are furthest from the median, `factor` times it or a `factor`th.

    Documents of no size say nothing and count nowhere; `n` is how many there are in all.
    """
    density = documents.where("size_bytes > 0").withColumn("density", F.col("chunks") * 1024 / F.col("size_bytes"))
    mid = density.groupBy("connector_id").agg(F.median("density").alias("mid"), F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("mid") > 0))
    found = density.join(mid.drop("n"), "connector_id").where((F.col("density") > factor * F.col("mid")) | (F.col("density") < F.col("mid") / factor))
    far = F.round(F.coalesce(F.abs(F.ln(F.col("density") / F.col("mid"))), F.lit(float("inf"))), 9)
    w = Window.partitionBy("connector_id")
    placed = found.withColumn("place", F.row_number().over(w.orderBy(F.desc(far), "doc_id"))).withColumn("n", F.count("*").over(w))
    return placed.where(F.col("place") <= shown).select("connector_id", "doc_id", "density", "place", "n")


#: Ranges of values in which `spread` numbers rows: one small row each.
RANGES = 1024


def spread(rows: DataFrame, count: int, by: str = "id") -> DataFrame:
    """An even sample: the rows numbered floor(i * n / count) in the order of `by` (whole numbers), without sorting all of them in one task.

    Rows are numbered within equal ranges of values, which the rows' own values name, so every reading gives
    the same numbers; the ranges' counts, RANGES rows at most, say where each begins.
    """
    ends = rows.agg(F.min(by).alias("_low"), F.max(by).alias("_high"))
    ranged = rows.crossJoin(F.broadcast(ends)).withColumn("_p", F.expr(f"int(least({RANGES - 1}, floor(({by} - _low) * {RANGES}.0D / (_high - _low + 1))))"))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_c"))
    base = sizes.withColumn("_base", F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).withColumn("_n", F.sum("_c").over(Window.partitionBy())).drop("_c")
    numbered = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(by)) - 1)
    numbered = numbered.join(F.broadcast(base), "_p").withColumn("_i", F.col("_i") + F.col("_base"))
    picked = F.floor((F.floor(F.col("_i") * count / F.col("_n")) + F.when((F.col("_i") * count) % F.col("_n") == 0, 0).otherwise(1)) * F.col("_n") / count)
    return numbered.where((F.col("_n") <= count) | ((picked == F.col("_i")) & (F.col("_i") < F.col("_n")))).select(*rows.columns)
