"""Memory facts of users: liveness, rank, eviction, supersession, dialogue turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HALF_LIFE_DAYS = 90


def live(now: Column) -> Column:
    return F.col("superseded_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now))


def rank(similarity: Column, confidence: Column, last_seen_at: Column, now: Column) -> Column:
    age = F.greatest(F.lit(0), F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(last_seen_at.cast("timestamp"))) / 86400
    return F.greatest(F.lit(0.0), similarity) * F.greatest(F.lit(0.0), confidence) * F.pow(F.lit(0.5), age / HALF_LIFE_DAYS)


def recall(facts: DataFrame, now: Column, k: int) -> DataFrame:
    """The k first live facts of each user: those always recalled, newest first, then the others by rank; ties by id."""
    rows = facts.where(live(now)).withColumn("score", F.round(rank(F.col("similarity"), F.col("confidence"), F.col("last_seen_at"), now), 9))
    newest = F.when(F.col("always"), F.unix_micros(F.col("last_seen_at").cast("timestamp")))
    w = Window.partitionBy("end_user_id").orderBy(F.desc("always"), F.desc_nulls_last(newest), F.desc(F.when(~F.col("always"), F.col("score"))), "fact_id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("end_user_id", "fact_id", "place", "score")


def similar(facts: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """Live facts among vector hits (fact_id, score), with the score as similarity; vectors whose fact is gone or closed drop out."""
    return facts.where(live(now)).join(hits.select("fact_id", F.col("score").alias("similarity")), "fact_id")


def over_budget(facts: DataFrame, now: Column, bound: int) -> DataFrame:
    """Facts to evict, dead ones before live ones.

    Where more facts than `bound` are live, every dead fact goes and the worst live ones beyond the bound;
    otherwise dead ones, worst first, until twice the bound are left in all.
    """
    rows = facts.withColumn("live", live(now)).withColumn("score", F.round(rank(F.lit(1.0), F.col("confidence"), F.col("last_seen_at"), now), 9))
    best = Window.partitionBy("end_user_id").orderBy(F.desc("live"), F.desc("score"), F.desc("fact_id"))
    placed = rows.withColumn("place", F.row_number().over(best))
    placed = placed.withColumn("n_live", F.count_if("live").over(Window.partitionBy("end_user_id")))
    allowed = F.when(F.col("n_live") > bound, bound).otherwise(2 * bound)
    return placed.where((F.col("place") > allowed) & (~F.col("live") | (F.col("n_live") > bound))).select("end_user_id", "fact_id")


def supersede(facts: DataFrame, closings: DataFrame) -> DataFrame:
    """Closes each listed fact once: the first closing counts, an earlier one stays."""
    first = closings.groupBy("fact_id").agg(F.min(F.struct("at", "replacement_id")).alias("_c"))
    return facts.join(first, "fact_id", "left").select(
        "fact_id",
        F.coalesce("superseded_at", "_c.at").alias("superseded_at"),
        F.when(F.col("superseded_at").isNull(), F.col("_c.replacement_id")).alias("replacement_id"),
    )


def questions(messages: DataFrame) -> DataFrame:
    """The last non-empty user turn of each conversation."""
    asked = messages.where("role = 'user' and trim(text) <> ''")
    return asked.groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("q")).select("conv_id", "q.turn", F.substring("q.text", -4000, 4000).alias("question"))


def session_keys(messages: DataFrame) -> DataFrame:
    """A key of each conversation from what was said through its first user turn."""
    first = messages.groupBy("conv_id").agg(F.min(F.when(F.col("role") == "user", F.col("turn"))).alias("upto"))
    head = messages.join(first, "conv_id").where("turn <= upto")
    said = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    text = F.array_join(F.transform(said, lambda m: F.concat(m["role"], F.lit(":"), F.coalesce(m["text"], F.lit("")))), "\n")
    return head.groupBy("conv_id").agg(F.substring(F.sha2(text, 256), 1, 32).alias("session_key"))


def tail(messages: DataFrame, budget: int = 12_000) -> DataFrame:
    """The most recent whole turns of each conversation within `budget` characters, at least one; a turn costs its text, its role and 2."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    length = lambda c: F.length(F.coalesce(c, F.lit("")))
    rows = messages.withColumn("n", length("text") + length("role") + 2)
    rows = rows.withColumn("used", F.sum("n").over(back.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(back))
    return rows.where((F.col("used") <= budget) | (F.col("place") == 1)).select("conv_id", "turn", "role", "n")


def route(requests: DataFrame, targets: DataFrame) -> DataFrame:
    """A/B target of each request: crc32 of key and gateway falls into the weights' bands. `targets` are a gateway's few rows."""
    # By rows: targets of one priority have bands of their own, in the order of their names.
    w = Window.partitionBy("gateway_id").orderBy("priority", "target").rowsBetween(Window.unboundedPreceding, 0)
    bands = targets.withColumn("high", F.sum("weight").over(w)).withColumn("low", F.col("high") - F.col("weight"))
    bands = bands.withColumn("total", F.sum("weight").over(Window.partitionBy("gateway_id")))
    draw = F.crc32(F.concat_ws(":", F.col("end_user_id").cast("string"), F.col("gateway_id").cast("string")))
    joined = requests.withColumn("draw", draw).join(bands, "gateway_id")
    return joined.where("draw % total >= low and draw % total < high").select("id", "target")
