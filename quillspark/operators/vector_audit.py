"""The audit of an index's vectors: one wide aggregate over the points, one over copies, and a bounded sample embedded anew.

points: id, document_id, embedding, text_hash and text.  A finding is a row (code, severity, count, documents);
what counts nothing is no finding.  Vectors that are null are not scanned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.vectors import cosine, norm
from quillspark.operators.findings import drift, worse
from quillspark.operators.retrieval import spread

#: Lengths that count as none, how far lengths may differ, how often a point's nearest must be of its own document, and when two texts' vectors are twins.
ZERO, SPREAD, AGREEMENT, TWIN = 1e-6, 1.5, 0.7, 0.98


def scanned(points: DataFrame, width: int) -> DataFrame:
    """One row: scanned, wrong_width, zero and documents of each, least and greatest length of those that have one."""
    n = points.where(F.col("embedding").isNotNull()).select("document_id", F.size("embedding").alias("w"), F.coalesce(norm("embedding"), F.lit(0.0)).alias("n"))
    wrong, zero, some = F.col("w") != width, F.col("n") < ZERO, F.col("n") >= ZERO
    documents = lambda c: F.count_distinct(F.when(c, F.col("document_id")))
    return n.agg(
        F.count("*").alias("scanned"), F.count_if(wrong).alias("wrong_width"), documents(wrong).alias("wrong_documents"), F.count_if(zero).alias("zero"), documents(zero).alias("zero_documents"),
        F.min(F.when(some, F.col("n"))).alias("low"), F.max(F.when(some, F.col("n"))).alias("high"), F.count_if(some).alias("lengths"),
    )


def copies(points: DataFrame) -> DataFrame:
    """One row: points (and their documents) whose vector is another point's to six places, for another text."""
    key = F.sha2(F.concat_ws(",", F.transform("embedding", lambda x: F.format_number(x.cast("double"), 6))), 256)
    rows = points.where(F.col("embedding").isNotNull() & (F.coalesce(norm("embedding"), F.lit(0.0)) >= ZERO)).select("document_id", "text_hash", key.alias("k"))
    # Counted by vector and document first, so that a vector of very many copies is a few rows.
    by_document = rows.groupBy("k", "document_id").agg(F.count("*").alias("n"), F.min("text_hash").alias("a"), F.max("text_hash").alias("b"))
    by_vector = by_document.groupBy("k").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b").select("k")
    return by_document.join(by_vector, "k").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("identical"), F.count_distinct("document_id").alias("identical_documents"))


def twins(neighbours: DataFrame, points: DataFrame) -> DataFrame:
    """query_id, own, other and score of sampled points whose nearest point is of another document and as similar as TWIN."""
    own = points.select(F.col("id").alias("query_id"), F.col("document_id").alias("own"))
    near = points.select("id", F.col("document_id").alias("other"))
    rows = neighbours.where("rank = 1").join(own, "query_id").join(near, "id")
    return rows.where((F.col("own") != F.col("other")) & (F.col("score") >= TWIN)).select("query_id", "own", "other", "score")


def drift_samples(points: DataFrame, embed: Callable[[DataFrame], DataFrame], count: int, model: str) -> DataFrame:
    """model and cosine of an even sample of `count` points, whose texts `embed` (id, text to id, embedding) embeds anew."""
    some = spread(points.where("embedding is not null").select("id", "text", "embedding"), count)
    fresh = embed(some.select("id", "text")).select("id", F.col("embedding").alias("fresh"))
    return some.join(fresh, "id").select(F.lit(model).alias("model"), F.round(cosine("embedding", "fresh"), 6).alias("cosine"))


def findings(points: DataFrame, width: int, model: str, documents: DataFrame, neighbours: DataFrame | None = None, samples: DataFrame | None = None) -> DataFrame:
    """code, severity, count, documents of all findings; documents: document_id, embedding_model (null: not embedded)."""
    every = scanned(points, width).crossJoin(copies(points))  # a row each
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("scanned")), F.lit(0.0))
    two = lambda c: F.when(c, 2).otherwise(1)
    row = lambda code, rank, count, docs: F.struct(F.lit(code).alias("code"), worse(rank).alias("severity"), count.cast("bigint").alias("count"), docs.cast("bigint").alias("documents"))
    rows = [
        row("dimension_mismatch", F.lit(2), F.col("wrong_width"), F.col("wrong_documents")),
        row("zero_vectors", two(share("zero") >= 0.01), F.col("zero"), F.col("zero_documents")),
        row("identical_vectors", two(share("identical") >= 0.05), F.col("identical"), F.col("identical_documents")),
        row("norm_spread", F.lit(1), F.when(F.col("high") / F.col("low") > SPREAD, F.col("lengths")).otherwise(0), F.lit(None)),
    ]
    other = documents.where(F.col("embedding_model").isNotNull() & (F.col("embedding_model") != model)).agg(F.count("*").alias("n"))
    parts = [every.select(F.explode(F.array(*rows)).alias("f")), other.select(row("model_mismatch", F.lit(1), F.col("n"), F.col("n")).alias("f"))]
    if neighbours is not None:
        own, near = points.select(F.col("id").alias("query_id"), F.col("document_id").alias("own")), points.select("id", F.col("document_id").alias("other"))
        told = neighbours.where("rank = 1").join(own, "query_id").join(near, "id").withColumn("same", F.col("own") == F.col("other"))
        rate = told.agg(F.count("*").alias("n"), F.count_if("same").alias("same"), F.coalesce(F.avg(F.when(~F.col("same"), F.col("score"))), F.lit(0.0)).alias("alike"))
        low = F.coalesce(F.try_divide(F.col("same"), F.col("n")) < AGREEMENT, F.lit(False))
        parts.append(rate.select(row("low_agreement", F.when(F.col("alike") >= 0.9, 1).otherwise(2), F.when(low, F.col("n") - F.col("same")).otherwise(0), F.lit(None)).alias("f")))
        pairs = twins(neighbours, points).agg(F.count("*").alias("n"), F.count_distinct("own").alias("d"))
        parts.append(pairs.select(row("near_duplicate_vectors", F.lit(1), F.col("n"), F.col("d")).alias("f")))
    if samples is not None:
        told = drift(samples).where("shape <> 'healthy'")
        parts.append(told.select(row("drift", F.lit(2), F.round(F.col("below") * F.col("sampled")), F.lit(None)).alias("f")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("f.*").where("count > 0")
