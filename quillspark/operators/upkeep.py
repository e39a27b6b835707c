"""Runs over stored documents, what changed between snapshots, and what an erasure left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What may start a run, changes and examples shown, how alike vectors of a repeat are.
TRIGGERS = ("chunking", "embedding_model", "tokenizer", "summarization", "extractor", "manual")
MAX_CHANGES, MAX_SAMPLE, REPEAT = 100, 5, 0.98


def stalled(runs: DataFrame, documents: DataFrame, now: Column, after: str) -> DataFrame:
    """run_id, action, owned, resumed, status of open runs older than `after`, without those of a reindex.

    A run that still owns unfinished documents is continued; another is closed at its counters,
    partial if any document failed.
    """
    open_runs = runs.where(F.col("finished_at").isNull() & F.col("reindex_run_id").isNull() & (F.col("started_at") <= now - F.expr(f"interval {after}")))
    owned = documents.where(F.col("run_id").isNotNull() & ~F.col("finished")).groupBy("run_id").agg(F.count("*").alias("owned"))
    left = F.coalesce("owned", F.lit(0))
    done = F.when(F.col("failed") == 0, "succeeded").otherwise("partial")
    return open_runs.join(owned, "run_id", "left").select(
        "run_id",
        F.when(left > 0, "continue").otherwise("close").alias("action"),
        left.alias("owned"),
        (F.col("resumed") + F.when(left > 0, 1).otherwise(0)).alias("resumed"),
        F.when(left > 0, "running").otherwise(done).alias("status"),
    )


def reprocessed(outcomes: DataFrame) -> DataFrame:
    """run_id and its counters by outcome (succeeded, failed, skipped) and tokens; one aggregate in place of locked rows."""
    return outcomes.groupBy("run_id").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("succeeded", "failed", "skipped")), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def trigger(reasons: DataFrame, key: str = "run_id") -> DataFrame:
    """The commonest valid reason of each run (of equals the first by name), or manual."""
    counted = reasons.groupBy(key, "reason").agg(F.count("*").alias("n"))
    known = F.col("reason").isin(*TRIGGERS)
    best = F.min(F.when(known, F.struct((-F.col("n")).alias("n"), "reason")))
    return counted.groupBy(key).agg(F.coalesce(best["reason"], F.lit("manual")).alias("trigger"))


def progress(targets: DataFrame, now: Column) -> DataFrame:
    """done, total and eta_seconds by run; no estimate before the first point and after the last."""
    sums = targets.groupBy("run_id").agg(F.sum("done_points").alias("done"), F.sum("total_points").alias("total"), F.min("started_at").alias("started_at"))
    elapsed = F.unix_timestamp(now) - F.unix_timestamp("started_at")
    eta = F.when((F.col("done") > 0) & (elapsed > 0) & (F.col("done") < F.col("total")), F.floor((F.col("total") - F.col("done")) * elapsed / F.col("done")))
    return sums.select("run_id", "done", "total", eta.alias("eta_seconds"))


def swap_faults(targets: DataFrame, tolerance: int) -> DataFrame:
    """collection and why it must not be promoted; null if it may.  An empty collection that should be empty is fine."""
    fault = (
        F.when(F.col("points") < F.col("expected") - tolerance, "too few points")
        .when(F.col("expected") == 0, None)
        .when(F.col("width") != F.col("model_width"), "other width")
        .when(F.col("found") == 0, "search finds nothing")
    )
    return targets.select("collection", fault.alias("fault"))


def stale_alerts(connectors: DataFrame, now: Column, older_than_hours: float) -> DataFrame:
    """connector_id, stale, age_hours of connectors whose oldest stale document waits longer."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("oldest")) / 3600
    return connectors.where(age >= older_than_hours).select("connector_id", "stale", F.round(age, 1).alias("age_hours"))


def erasure(stores: DataFrame) -> DataFrame:
    """subject_id, removed, complete: complete only if every store says so."""
    return stores.groupBy("subject_id").agg(F.sum("removed").alias("removed"), F.bool_and("complete").alias("complete"))


def changes(before: DataFrame, after: DataFrame, key: str, most: int = MAX_CHANGES) -> DataFrame:
    """key, path, before, after, omitted: fields that differ between two snapshots (a map from path to value).

    A path that one side lacks was made or removed; a null on both sides is no change.  The first
    `most` paths of a subject are shown, `omitted` says how many are not.
    """
    left = before.select(key, F.explode("fields").alias("path", "before")).withColumn("had", F.lit(True))
    right = after.select(key, F.explode("fields").alias("path", "after")).withColumn("has", F.lit(True))
    differ = left.join(right, [key, "path"], "full").where(~(F.col("before").eqNullSafe(F.col("after")) & F.col("had").isNotNull() & F.col("has").isNotNull()))
    of = Window.partitionBy(key)
    placed = differ.withColumns({"place": F.row_number().over(of.orderBy("path")), "n": F.count("*").over(of)})
    return placed.where(F.col("place") <= most).select(key, "path", "before", "after", F.greatest(F.col("n") - most, F.lit(0)).alias("omitted"))


def sampled(rows: DataFrame, key: str, value: str, most: int = MAX_SAMPLE) -> DataFrame:
    """key, n, sample: how many rows, and the first few values in order."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    first = rows.select(key, value).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(value))).where(F.col("place") <= most)
    return counts.join(first.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("sample")), key)


def item_counts(items: DataFrame) -> DataFrame:
    """total, verified, generated and negatives (no relevant chunk or document) of each evaluation set."""
    negative = (F.size("relevant") == 0) & (F.size("relevant_document_ids") == 0)
    return items.groupBy("set_id").agg(
        F.count("*").alias("total"), F.count_if("verified").alias("verified"), F.count_if(F.col("source") == "generated").alias("generated"), F.count_if(negative).alias("negatives")
    )


def newest(rows: DataFrame, key: str, at: str, id_: str, most: int) -> DataFrame:
    """The newest rows of each key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc(id_)))).where(F.col("place") <= most).drop("place")


def candidate_chunks(documents: DataFrame, chunks: DataFrame, excluded: DataFrame, count: int, least_tokens: int, per_connector: int) -> DataFrame:
    """chunk_id, document_id: the middle usable chunk of documents spread evenly, at most `count`.

    At most `per_connector` documents of each connector are looked at, so the one numbering of all is of a bounded list.
    """
    first = documents.withColumn("n", F.row_number().over(Window.partitionBy("connector_id").orderBy("document_id"))).where(F.col("n") <= per_connector)
    listed = first.select("document_id", (F.row_number().over(Window.orderBy("connector_id", "document_id")) - 1).alias("rank"))
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy()) / max(count, 1)))
    strided = listed.withColumn("turn", F.col("rank") % step)
    usable = chunks.where(F.col("token_count") >= least_tokens).join(excluded, "chunk_id", "left_anti")
    of = Window.partitionBy("document_id")
    middle = usable.withColumns({"i": F.row_number().over(of.orderBy("chunk_index", "chunk_id")) - 1, "n": F.count("*").over(of)}).where("i = n div 2")
    return strided.join(middle, "document_id").orderBy("turn", "rank").limit(count).select("chunk_id", "document_id")


def cross_duplicates(neighbours: DataFrame) -> DataFrame:
    """Nearest neighbours that repeat a chunk of another document."""
    return neighbours.where((F.col("document_id") != F.col("other_document_id")) & (F.col("score") >= REPEAT))


def still_holds(labels: DataFrame, chunks: DataFrame, fold) -> DataFrame:
    """label_id, holds: the label's chunk is there and contains its folded text."""
    found = chunks.select("chunk_id", fold(F.col("text")).alias("body"))
    return labels.join(found, "chunk_id", "left").select("label_id", F.coalesce(F.contains("body", fold(F.col("label"))), F.lit(False)).alias("holds"))


def reindex_estimate(points: DataFrame, chars_per_token: int = 4) -> DataFrame:
    """points and tokens that embedding all of them again takes, from the mean length of what was embedded."""
    mean = F.coalesce(F.avg(F.length("text")), F.lit(0.0))
    return points.groupBy("organization_id").agg(F.count("*").alias("points"), F.floor(F.count("*") * mean / chars_per_token).alias("tokens"))
