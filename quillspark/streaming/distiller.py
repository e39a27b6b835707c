"""One pass over a session once it has been quiet, and an exactly-once commit of what the pass found.

A session's transcripts wait in state, and each later one puts off the pass that is due.  When the
watermark has passed the end of quiet, the session's transcripts leave as one row, in the order of
time.  `distil` takes such passes batch by batch: it judges each one, asks `extract` for the facts of those that are
worth it, and writes facts and passes under the batch's own number, which replaces what a failed attempt left.  A last
small file says that the batch is whole; readers see only batches that have it.

Defined cases: transcripts at one time come in the order of their ids; an empty or null text counts as a transcript
without characters; a transcript behind the watermark is dropped; one that comes after its pass starts another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark.sources.shared import remove

PASS = "end_user_id bigint, session_id string, due_ms bigint, transcripts array<struct<log_id:bigint,at_ms:bigint,text:string>>"
_COLUMNS = ["end_user_id", "session_id", "due_ms", "transcripts"]
#: Outcomes, in the order in which they are decided.
TOO_SHORT, OVER_CAP, DISTILLED = "too_short", "over_cap", "succeeded"


class Quiet(StatefulProcessor):
    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "log_id bigint, at_ms bigint, text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(i), int(at), t) for frame in rows for i, at, t in frame[["log_id", "at_ms", "text"]].itertuples(index=False)]
        before = list(self.waiting.get()) if self.waiting.exists() else []
        yield self._passes(key, sorted(before + new, key=lambda x: (x[1], x[0])), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = sorted(self.waiting.get(), key=lambda x: (x[1], x[0])) if self.waiting.exists() else []
        yield self._passes(key, waiting, expiredTimerInfo.getExpiryTimeInMs())

    def _passes(self, key, waiting: list, now: int) -> pd.DataFrame:
        """The sessions that are over; what is left stays, and wakes the key when it is due."""
        out, session = [], []
        for row in waiting:
            if session and row[1] - session[-1][1] > self.quiet_ms and session[-1][1] + self.quiet_ms <= now:
                out.append(session)
                session = []
            session.append(row)
        if session and session[-1][1] + self.quiet_ms <= now:
            out.append(session)
            session = []
        if session:
            self.waiting.put(session)
            self.handle.registerTimer(next(a for a, b in zip([r[1] + self.quiet_ms for r in session], [*[r[1] for r in session[1:]], 1 << 62], strict=True) if b > a))
        else:
            self.waiting.clear()
        rows = [(int(key[0]), key[1], s[-1][1] + self.quiet_ms, [{"log_id": i, "at_ms": at, "text": t} for i, at, t in s]) for s in out]
        return pd.DataFrame(rows, columns=_COLUMNS)

    def close(self) -> None:
        pass


def passes(stream: DataFrame, quiet: int, delay: str) -> DataFrame:
    """end_user_id, session_id, due_ms and transcripts of each quiet session of a stream of log_id, end_user_id, session_id, ts, text."""
    cols = stream.withWatermark("ts", delay).selectExpr("end_user_id", "coalesce(session_id, '') as session_id", "ts", "log_id", "unix_millis(ts) as at_ms", "text")
    return cols.groupBy("end_user_id", "session_id").transformWithStateInPandas(Quiet(quiet * 1000), PASS, "Append", "EventTime")


def judged(found: DataFrame, earlier: DataFrame, least_chars: int, daily: int) -> DataFrame:
    """Passes with their `outcome`; `daily` passes of a user succeed a day, those of earlier batches (end_user_id, due_ms, outcome) counted."""
    day = F.floor(F.col("due_ms") / 86_400_000)
    chars = F.aggregate("transcripts", F.lit(0), lambda a, t: a + F.length(F.trim(F.coalesce(t["text"], F.lit("")))))
    new = found.select("*", day.alias("day"), chars.alias("chars"))
    used = earlier.where(F.col("outcome") == DISTILLED).groupBy("end_user_id", day.alias("day")).agg(F.count("*").alias("used"))
    order = Window.partitionBy("end_user_id", "day", F.col("chars") >= least_chars).orderBy("due_ms", "session_id")
    place = F.row_number().over(order) + F.coalesce("used", F.lit(0))
    outcome = F.when(F.col("chars") < least_chars, TOO_SHORT).when(F.col("place") > daily, OVER_CAP).otherwise(DISTILLED)
    return new.join(used, ["end_user_id", "day"], "left").withColumn("place", place).withColumn("outcome", outcome).drop("place", "used", "day")


def _committed(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """Rows of whole batches."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/whole")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], f"{schema}, batch bigint")
    whole = spark.read.schema("batch bigint").parquet(f"{path}/whole")
    rows = spark.read.schema(f"{schema}, batch bigint").option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
    return rows.join(F.broadcast(whole.distinct()), "batch", "left_semi")


MARK = "end_user_id bigint, session_id string, due_ms bigint, log_ids array<bigint>, chars bigint, outcome string"


def marks(spark: SparkSession, path: str) -> DataFrame:
    """Every pass that was made, with the transcripts it read."""
    return _committed(spark, path, "passes", MARK)


def facts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return _committed(spark, path, "facts", schema)


def distil(found: DataFrame, path: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame], least_chars: int = 40, daily: int = 50):
    """Starts the stream that commits `passes`; `extract` makes rows of facts of the passes that succeeded."""

    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = judged(batch, marks(spark, path).where(F.col("batch") < number), least_chars, daily)
        done = done.select("end_user_id", "session_id", "due_ms", "transcripts", F.transform("transcripts", lambda t: t["log_id"]).alias("log_ids"), F.col("chars").cast("bigint").alias("chars"), "outcome")
        # Written once and read by both, so that facts and marks are of the same judgement.
        done.write.mode("overwrite").parquet(f"{path}/judged/batch={number}")
        held = spark.read.schema(done.schema).parquet(f"{path}/judged/batch={number}")
        extract(held.where(F.col("outcome") == DISTILLED)).write.mode("overwrite").parquet(f"{path}/facts/batch={number}")
        held.drop("transcripts").write.mode("overwrite").parquet(f"{path}/passes/batch={number}")
        spark.range(number, number + 1).toDF("batch").coalesce(1).write.mode("overwrite").parquet(f"{path}/whole/n={number}")
        remove(spark, f"{path}/judged/batch={number}")

    return found.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
