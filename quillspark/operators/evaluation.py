"""Retrieval evaluation: scores of items, run metrics, differences of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scored(items: DataFrame, k: int, more: tuple[str, ...] = ()) -> DataFrame:
    """item_id and recall, precision, rr, hit of each item (retrieved: array in rank order, relevant: array, both of ids).

    Precision divides by what was retrieved (up to k), and is 0 for nothing; recall counts different hits.
    An item marked `negative` wants nothing: precision is 1 if nothing was retrieved, else 0; the rest is null.
    An item that isn't negative and has no relevant ids at this level says nothing: all is null.  Columns named by `more` come along.
    """
    top = F.slice(F.coalesce("retrieved", F.expr("cast(array() as array<bigint>)")), 1, k)
    rel = F.array_distinct(F.coalesce("relevant", F.expr("cast(array() as array<bigint>)")))
    rows = items.select("item_id", *more, F.coalesce("negative", F.lit(False)).alias("negative"), top.alias("top"), rel.alias("rel"))
    rows = rows.withColumn("good", F.expr("filter(transform(top, (x, i) -> if(array_contains(rel, x), i + 1, null)), p -> p is not null)"))
    negative, labelled = F.col("negative"), ~F.col("negative") & (F.size("rel") > 0)
    return rows.select(
        "item_id",
        *more,
        "negative",
        F.when(labelled, F.size(F.array_intersect("top", "rel")) / F.size("rel")).alias("recall"),
        F.when(negative, (F.size("top") == 0).cast("double")).when(labelled, F.coalesce(F.try_divide(F.size("good"), F.size("top")), F.lit(0.0))).alias("precision"),
        F.when(labelled, F.coalesce(1 / F.try_element_at("good", F.lit(1)), F.lit(0.0))).alias("rr"),
        F.when(labelled, (F.size("good") > 0).cast("double")).alias("hit"),
    )


def run_metrics(scores: DataFrame) -> DataFrame:
    """Means that skip nulls; a negative item counts as clean if nothing was retrieved for it."""
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return scores.agg(
        F.count("*").alias("items"),
        F.count_if("negative").alias("negatives"),
        F.count_if(F.col("negative") & (F.col("precision") == 1)).alias("clean_negatives"),
        *(mean(c) for c in ("recall", "precision", "rr", "hit")),
    )


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Items of both runs that were won or lost, and by how much recall moved."""
    b, a = before.alias("b"), after.alias("a")
    return (
        b.join(a, F.expr("b.item_id = a.item_id"))
        .where("coalesce(b.hit, -1) <> coalesce(a.hit, -1)")
        .select(F.col("a.item_id").alias("item_id"), F.expr("case when coalesce(a.hit, 0) > coalesce(b.hit, 0) then 'won' else 'lost' end").alias("outcome"), F.expr("round(a.recall - b.recall, 6)").alias("recall_delta"))
    )


#: Granularities, each before and after the prompt's budget.
LEVELS = ("chunk", "chunk_injected", "document", "document_injected")


def relevant_documents(labels: DataFrame, named: DataFrame) -> DataFrame:
    """item_id and relevant (document ids, each once, sorted): documents that an item names and those of its labelled chunks.

    labels: item_id, chunk_id, document_id (null where the chunk is gone); named: item_id, document_id.
    """
    every = labels.select("item_id", "document_id").unionByName(named.select("item_id", "document_id"))
    return every.where(F.col("document_id").isNotNull()).groupBy("item_id").agg(F.sort_array(F.collect_set("document_id")).alias("relevant_documents"))


def injected(retrieved: DataFrame, budget: int) -> DataFrame:
    """retrieved (item_id, rank, chunk_id, document_id, tokens) with `injected`: whether the chunk is within the prompt's budget.

    Chunks are taken by rank while they fit; one that doesn't fit ends it.
    """
    upto = F.sum("tokens").over(Window.partitionBy("item_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return retrieved.withColumn("injected", upto <= budget)


def level_scores(items: DataFrame, k: int) -> DataFrame:
    """level, item_id, verified, negative, recall, precision, rr, hit of every item at each of LEVELS.

    items: item_id, verified, retrieved (an array, in the order of rank, of chunk_id, document_id, injected), relevant_chunks,
    relevant_documents.  An item without labels at either granularity is negative; one labelled at the other granularity only says nothing at this one.
    """
    none = F.expr("cast(array() as array<bigint>)")
    some = lambda c: F.coalesce(F.col(c), none)
    negative = (F.size(some("relevant_chunks")) == 0) & (F.size(some("relevant_documents")) == 0)
    first = F.slice("retrieved", 1, k)

    def level(name: str) -> Column:
        kind = name.split("_")[0]
        kept = F.filter(first, lambda r: F.coalesce(r["injected"], F.lit(False))) if name.endswith("injected") else first
        return F.struct(F.lit(name).alias("level"), F.transform(kept, lambda r: r[f"{kind}_id"].cast("bigint")).alias("retrieved"), some(f"relevant_{kind}s").alias("relevant"))

    # An item's levels are made from its row, so the items are read once.
    rows = items.select("item_id", F.coalesce("verified", F.lit(False)).alias("verified"), negative.alias("negative"), F.explode(F.array(*map(level, LEVELS))).alias("_level"))
    scores = scored(rows.select("item_id", "verified", "negative", "_level.*"), k, ("level", "verified"))
    return scores.select("item_id", "negative", "recall", "precision", "rr", "hit", "level", "verified")


def run_levels(scores: DataFrame) -> DataFrame:
    """Metrics of each level over all items and over the verified ones; `scored` counts the items that say something about recall."""
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    pops = scores.withColumn("population", F.explode(F.when(F.col("verified"), F.array(F.lit("all"), F.lit("verified"))).otherwise(F.array(F.lit("all")))))
    return pops.groupBy("population", "level").agg(
        F.count("*").alias("items"), F.count("recall").alias("scored"), F.count_if("negative").alias("negatives"), F.count_if(F.col("negative") & (F.col("precision") == 1)).alias("clean_negatives"),
        *(mean(c) for c in ("recall", "precision", "rr", "hit")),
    )


def metric_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """How each metric of each population and level moved from one run's `run_levels` to another's; null where either has none."""
    b, a = before.alias("b"), after.alias("a")
    rows = b.join(a, ["population", "level"])
    return rows.select("population", "level", *(F.round(F.col(f"a.{c}") - F.col(f"b.{c}"), 6).alias(f"{c}_delta") for c in ("recall", "precision", "rr", "hit")))
