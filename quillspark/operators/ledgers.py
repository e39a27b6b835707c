"""Ledgers and health rollups: filtered counts, totals with days in one pass, latest rows, status pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def health(runs: DataFrame) -> DataFrame:
    """Per day, and over all days (day null), from one rollup: runs, failures, rate, spend, people."""
    return (
        runs.rollup("day")
        .agg(
            F.count("*").alias("runs"),
            F.count_if(F.col("outcome") == "F").alias("finished"),
            F.count_if(F.col("outcome") == "P").alias("failed"),
            F.count_distinct("end_user_id").alias("people"),
            F.round(F.sum("spend"), 2).alias("spend"),
        )
        .withColumn("failure_rate", F.round(F.coalesce(F.try_divide(F.col("failed"), F.col("runs")), F.lit(0.0)), 6))
    )


def spend_by(runs: DataFrame, names: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """Largest spenders with their names; one without a name stays."""
    sums = runs.groupBy(key).agg(F.count("*").alias("runs"), F.round(F.sum("spend"), 2).alias("spend"))
    # The limit comes before the join: a bounded number of rows looks for its name.
    return sums.orderBy(F.desc("spend"), key).limit(limit).join(names.select(key, "name"), key, "left")


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The newest row of each key by `order`; a map-side maximum instead of a sort."""
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("_last")
    return rows.groupBy(*keys).agg(newest).select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest))


def index_status(documents: DataFrame) -> Column:
    """An indexed document without a fingerprint is unrecorded, and never stale."""
    return F.expr("case when status = 'indexed' and fingerprint is null then 'unrecorded' else index_status end")


def status_counts(documents: DataFrame) -> DataFrame:
    wide = documents.withColumn("s", index_status(documents)).groupBy("connector_id").pivot("s", ["current", "stale", "unrecorded"]).count()
    return wide.na.fill(0)


def totals(documents: DataFrame, key: str) -> DataFrame:
    return documents.groupBy(key).agg(F.count("*").alias("documents"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))


def stale_summaries(connectors: DataFrame, documents: DataFrame) -> DataFrame:
    stale = documents.where("index_status = 'stale'").groupBy("connector_id").agg(F.count("*").alias("stale"), F.min("updated_at").alias("oldest"))
    return connectors.join(stale, "connector_id")


def pressure(readings: DataFrame, least: float = 0.8) -> DataFrame:
    """The fullest limit of each gateway, if it is `least` full or more."""
    worst = readings.groupBy("gateway_id").agg(F.max(F.struct("utilisation", "limit_name")).alias("w"))
    return worst.where(F.col("w.utilisation") >= least).select("gateway_id", "w.utilisation", "w.limit_name")


def ceilings(limits: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The stricter of limit and ceiling (null is unlimited), and which limits were capped."""
    capped = F.filter(F.array(*(F.when(F.col(f"{n}_ceiling") < F.coalesce(n, F.lit(2**31 - 1)), F.lit(n)) for n in names)), lambda x: x.isNotNull())
    return limits.select("id", *(F.least(n, f"{n}_ceiling").alias(n) for n in names), F.array_join(capped, ",").alias("capped"))
