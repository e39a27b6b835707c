"""A stream's answer over a stored table: the table goes through the stream in micro-batches, and what it emitted is read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quillspark.sources.shared import shared_folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def own_session(spark: SparkSession) -> SparkSession:
    """A session of its own, so that the state store of these streams is set for them alone.

    The state is in as many parts as there are cores, if these are fewer than the partitions of a shuffle, as each part has its store and its worker in every batch.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    session.conf.set("spark.sql.shuffle.partitions", min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, spark.sparkContext.defaultParallelism)))
    return session


def deal(events: DataFrame, arrival: Column, batches: int, path: str) -> None:
    """Writes events in `batches` files by stretches of their arrival, one after another, so that a stream reads a file a batch in this order."""
    micros = F.unix_micros(arrival)
    low, high = (x or 0 for x in events.agg(F.min(micros), F.max(micros)).first())
    width = max(1, -(-(high - low + 1) // batches))
    # Parted once, so that a batch is read from its own files and not picked from the whole table.
    staged = shared_folder(events.sparkSession, "staged")
    events.withColumn("_batch", F.floor((micros - low) / width).cast("int")).repartition("_batch").write.mode("overwrite").partitionBy("_batch").parquet(staged)
    parts = events.sparkSession.read.schema(StructType([*events.schema.fields, StructField("_batch", IntegerType())])).parquet(staged)
    for k in range(batches):
        parts.where(F.col("_batch") == k).select(*events.columns).coalesce(1).write.mode("append").parquet(path)


def replayed(events: DataFrame, transform: Callable[[DataFrame], DataFrame], arrival: Column, batches: int = 4, more: DataFrame | None = None) -> DataFrame:
    """What `transform` of a stream emits for all `events` in the order of `arrival`, and after them `more` as a last batch, such as a row that moves the watermark on."""
    spark = events.sparkSession
    root = shared_folder(spark, "stream")
    deal(events, arrival, batches, f"{root}/in")
    if more is not None:
        more.select(*events.columns).coalesce(1).write.mode("append").parquet(f"{root}/in")
    session = own_session(spark)
    stream = session.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    out = transform(stream)
    running = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")
