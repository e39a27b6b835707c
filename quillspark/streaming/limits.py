"""Rate limits, debounced sessions and the micro-batch log sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DECISION = "event_id bigint, allowed boolean, used double"


def weighted(previous: float, current: float, into: float, seconds: int) -> float:
    return previous * (1 - into / seconds) + current


class _Counter:
    """Sliding counter of one key: the count of this bucket, and that of the one before, fading."""

    def __init__(self, bucket: int = 0, previous: float = 0.0, current: float = 0.0):
        self.bucket, self.previous, self.current = bucket, previous, current

    def consume(self, at: float, cost: float, limit: float, seconds: int) -> tuple[bool, float]:
        bucket = int(at // seconds)
        if bucket > self.bucket:
            self.previous = self.current if bucket == self.bucket + 1 else 0.0
            self.bucket, self.current = bucket, 0.0
        used = weighted(self.previous, self.current, at - bucket * seconds, seconds)
        if used + cost > limit:
            return False, used
        self.current += cost
        return True, used + cost


def replay(events: DataFrame, limit: float, seconds: int) -> DataFrame:
    """event_id, allowed, used: what the limiter decided for each event of a key, in order of time.

    A refused event consumes nothing. Rows of one key come sorted and in batches, so a hot key streams
    through its task with constant memory.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, counter = None, _Counter()
        for batch in it:
            rows = []
            for e, k, at, cost in batch.itertuples(index=False):
                if k != key:
                    key, counter = k, _Counter()
                rows.append((e, *counter.consume(at, cost, limit, seconds)))
            yield pd.DataFrame(rows, columns=["event_id", "allowed", "used"])

    cols = events.select("event_id", "key", F.col("at").cast("double").alias("at"), F.col("cost").cast("double").alias("cost"))
    return cols.repartition("key").sortWithinPartitions("key", "at", "event_id").mapInPandas(run, DECISION)


class Limiter(StatefulProcessor):
    """The same limiter over a stream, with one small state a key."""

    def __init__(self, limit: float, seconds: int):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("counter", "bucket bigint, previous double, current double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        counter = _Counter(*self.state.get()) if self.state.exists() else _Counter()
        events = pd.concat(list(rows)).sort_values(["at", "event_id"])
        out = [(e.event_id, *counter.consume(float(e.at), float(e.cost), self.limit, self.seconds)) for e in events.itertuples()]
        self.state.update((counter.bucket, counter.previous, counter.current))
        yield pd.DataFrame(out, columns=["event_id", "allowed", "used"])

    def close(self) -> None:
        pass


def limited(stream: DataFrame, limit: float, seconds: int) -> DataFrame:
    """Decisions over a stream of event_id, key, at (seconds), cost; needs the RocksDB state store."""
    return stream.groupBy("key").transformWithStateInPandas(Limiter(limit, seconds), DECISION, "Append", "None")


def peek(events: DataFrame, seconds: int, now: float) -> DataFrame:
    """key and used of each key at `now`, from counts of this and the last bucket; nothing is consumed."""
    bucket = int(now // seconds)
    b = F.floor(F.col("at") / seconds)
    cost = lambda n: F.coalesce(F.sum(F.when(b == n, F.col("cost"))), F.lit(0))
    live = events.where(b.isin(bucket, bucket - 1) & (F.col("at") <= now))
    fading = 1 - (now - bucket * seconds) / seconds
    return live.groupBy("key").agg(F.round(cost(bucket - 1) * fading + cost(bucket), 6).alias("used"))


def sessions(events: DataFrame, gap: str, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Quiet-period sessions of each key: one pass is due at each session's end. Works on batches and streams."""
    out = events.groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("events"))
    return out.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")


def failures(events: DataFrame, seconds: int, most: int) -> DataFrame:
    """Fixed windows in which a key failed more than `most` times."""
    out = events.groupBy("key", F.window("ts", f"{seconds} seconds").start.alias("bucket")).agg(F.count("*").alias("failures"))
    return out.where(F.col("failures") > most)


def latest_per_session(batch: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("event_id"))
    return batch.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def write_log(stream: DataFrame, path: str, checkpoint: str, redact: dict | None = None, available_now: bool = False):
    """Micro-batches of log rows into day partitions, redacted; a batch that is tried again replaces its own files."""

    def put(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumns(redact or {}).withColumns({"day": F.to_date("ts"), "batch": F.lit(epoch)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.trigger(processingTime="500 milliseconds").start()
