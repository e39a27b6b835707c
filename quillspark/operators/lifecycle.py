"""Lifecycle jobs: resync, orphans, retention, partition runway, staleness, upserts as rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENTS = (("em", "embedding_model"), ("tk", "tokenizer"), ("ch", "chunking"), ("sm", "summarization"), ("xv", "extraction"))


#: States in which nothing works on a document any more.
FINAL = ("indexed", "failed", "skipped")


def reconcile(listing: DataFrame, documents: DataFrame) -> DataFrame:
    """key and what a resync does with it: added, updated, unchanged, skipped (listed, in work), deleted or kept (not listed, in work).

    A null etag is an etag like others; a document without a status is in work.
    """
    listed = listing.select("key", F.col("etag").alias("new"), F.lit(True).alias("listed"))
    known = documents.select("key", F.col("etag").alias("old"), F.coalesce(F.col("status").isin(*FINAL), F.lit(False)).alias("final"))
    both = listed.join(known, "key", "full_outer")
    return both.select(
        "key",
        F.when(F.col("final").isNull(), "added")
        .when(F.col("listed").isNull(), F.when(F.col("final"), "deleted").otherwise("kept"))
        .when(~F.col("final"), "skipped")
        .when(F.col("new").eqNullSafe(F.col("old")), "unchanged")
        .otherwise("updated")
        .alias("action"),
    )


def orphans(things: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    return things.join(owners.select(key), key, "left_anti")


def retention(partitions: DataFrame, today: str, metadata_days: int, body_days: int, floor: str | None = None) -> DataFrame:
    """day and what happens to it: drop all, strip bodies, or keep; null windows keep forever, days before `floor` were done before."""
    day = F.col("day")
    before = lambda n: day < F.date_sub(F.lit(today).cast("date"), n)
    settled = F.lit(False) if floor is None else day < F.lit(floor).cast("date")
    return partitions.select("day", F.when(settled, "keep").when(before(metadata_days), "drop").when(before(body_days), "strip").otherwise("keep").alias("action"))


def missing_days(existing: DataFrame, today: str, ahead: int, behind: int) -> DataFrame:
    at = F.lit(today).cast("date")
    calendar = existing.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(at, behind), F.date_add(at, ahead))).alias("day"))
    return calendar.join(existing.select("day"), "day", "left_anti")


def partition_plan(existing: DataFrame, today: str, ahead: int, behind: int, keep_days: int) -> DataFrame:
    """action and day: partitions to create around today, and those past `keep_days` to drop."""
    old = existing.where(F.col("day") < F.date_sub(F.lit(today).cast("date"), keep_days))
    create = missing_days(existing, today, ahead, behind).select(F.lit("create").alias("action"), "day")
    return create.unionByName(old.select(F.lit("drop").alias("action"), "day"))


def runway(existing: DataFrame, today: str) -> DataFrame:
    """days_ahead: how many days from `today` on are there without a gap. One row a day: a small window."""
    later = existing.where(F.col("day") >= F.lit(today).cast("date")).select("day").distinct()
    gap = F.date_diff("day", F.lit(today).cast("date")) - F.row_number().over(Window.orderBy("day")) + 1
    return later.withColumn("gap", gap).where("gap = 0").agg(F.count("*").alias("days_ahead"))


def fingerprint(*segments: Column) -> Column:
    """ch=..;em=..;tk=..;sm=..;xv=.. of five columns, each by the first 12 hex digits of its SHA-256."""
    names = ("ch", "em", "tk", "sm", "xv")
    return F.concat_ws(";", *(F.concat(F.lit(f"{n}="), F.substring(F.sha2(c.cast("string"), 256), 1, 12)) for n, c in zip(names, segments, strict=True)))


def stale_reason(recorded: Column, expected: Column) -> Column:
    """First segment that differs, in the order of SEGMENTS; 'unrecorded' without a readable fingerprint."""
    was, now = F.str_to_map(recorded, F.lit(";"), F.lit("=")), F.str_to_map(expected, F.lit(";"), F.lit("="))
    readable = F.coalesce(F.size(F.array_intersect(F.map_keys(was), F.array(*(F.lit(n) for n, _ in SEGMENTS)))) == len(SEGMENTS), F.lit(False))
    out = F.when(~readable, "unrecorded")
    for n, reason in SEGMENTS:
        out = out.when(was[n] != now[n], reason)
    return out


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """`current` with `changes` laid over it by key; a null in a change keeps what was there."""
    rest = [c for c in current.columns if c != key]
    new = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in rest))
    return current.join(new, key, "full_outer").select(key, *(F.coalesce(f"_new_{c}", c).alias(c) for c in rest))


def bump(users: DataFrame, seen: DataFrame) -> DataFrame:
    """Counters raised and last_seen moved on, never back; `seen` is added up before it meets the users."""
    tally = seen.groupBy("end_user_id").agg(F.count("*").alias("_n"), F.max("created_at").alias("_at"))
    return users.join(tally, "end_user_id", "left").select(
        "end_user_id", (F.col("requests") + F.coalesce("_n", F.lit(0))).alias("requests"), F.greatest("last_seen", "_at").alias("last_seen")
    )


def replace_document(points: DataFrame, new: DataFrame) -> DataFrame:
    """All points of the documents in `new` give way to the new ones."""
    return points.join(new.select("document_id").distinct(), "document_id", "left_anti").select(*points.columns).unionByName(new)


def erase(rows: DataFrame, users: DataFrame) -> DataFrame:
    return rows.join(users.select("end_user_id"), "end_user_id", "left_anti").select(*rows.columns)
