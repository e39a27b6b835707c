"""Tables, and the request log as a projection of the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUESTS = {
    "id": "event_id",
    "created_at": "ts",
    "organization_id": "user_id % 2",
    "gateway_id": "user_id % 3",
    "end_user_id": "user_id",
    "model_name": "case when k % 11 = 0 then null else concat('m', cast(k % 4 as string)) end",
    "status_code": "case when event_type = 'error' then case when k % 2 = 0 then 429 else 500 end else 200 end",
    "error_code": "case when event_type = 'error' then case when k % 2 = 0 then 'rate_limited' else 'upstream_error' end end",
    "error_message": "case when event_type = 'error' then concat('upstream ', cast(k % 9 as string), ' said No') end",
    "session": "case when k % 5 > 0 then concat('s', cast(k % 4 as string)) end",
    "streamed": "k % 3 = 0",
    "latency_total_ms": "cast(floor(value * 10) as int)",
    "latency_ttft_ms": "case when k % 3 = 0 then cast(floor(value * 3) as int) end",
    "latency_retrieval_ms": "case when event_type <> 'signup' then cast(floor(value * 2) as int) end",
    "prompt_tokens": "case when event_type <> 'view' then k * 10 end",
    "completion_tokens": "case when event_type <> 'view' then k * 4 end",
    "estimated_prompt_tokens": "case when k % 5 <> 0 then k * 9 + 3 end",
    "tokenizer": "case when k % 6 > 0 then concat('tk', cast(k % 2 as string)) end",
    "n_retrieved": "case when event_type <> 'signup' then k % 4 end",
    "n_cited": "k % 2",
    "template": "concat('t', cast(k % 7 as string))",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log: one row per event, every column an expression, so that filters and pruning reach the scan."""
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return events.select(*(F.expr(e).alias(c) for c, e in REQUESTS.items()))


def scoped(df: DataFrame, organization_id: int | None) -> DataFrame:
    """Rows of one organization; None is the platform and sees all."""
    return df if organization_id is None else df.where(F.col("organization_id") == organization_id)


def binary_objects(spark: SparkSession, path: str) -> DataFrame:
    """Objects below a path: key, size_bytes, modified_at, content; without `content` only the listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("key"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), "content")


def _duck(expr: str) -> str:
    return expr.replace("as string)", "as varchar)")


#: The same projection for DuckDB, as a common table expression.
SQL_REQUESTS = (
    "r as (select " + ", ".join(f"{_duck(e)} as {c}" for c, e in REQUESTS.items())
    + " from (select *, cast(json_extract_string(props, '$.k') as int) as k from events))"
)


#: Documents of connectors: one row per order, every column an expression.
DOCUMENTS = {
    "id": "o_orderkey",
    "organization_id": "o_custkey % 4",
    "connector_id": "o_custkey % 25",
    "source_uri": "concat('drop/', cast(o_orderkey as string), '.txt')",
    "etag": "o_orderkey % 5",
    "status": "case o_orderkey % 7 when 0 then 'failed' when 1 then 'parsing' when 2 then 'skipped' else 'indexed' end",
    "reason": "case when o_orderkey % 7 = 0 then case o_orderkey % 3 when 0 then 'missing_object' when 1 then 'too_large' end end",
    "mime_type": "case o_orderkey % 8 when 0 then 'text/html' when 1 then 'application/pdf' when 2 then 'text/markdown' when 3 then 'application/x-unknown' when 4 then 'text/plain' when 5 then 'text/x-python' when 6 then 'text/csv' end",
    "size_bytes": "o_orderkey * 37 % 9000",
    "chunks": "o_orderkey % 40",
    "index_fingerprint": "case when o_orderkey % 5 > 1 then concat('ch=', cast(o_orderkey % 3 as string), ';em=m', cast(o_custkey % 2 as string), ';tk=w;sm=n;xv=1') when o_orderkey % 5 = 1 then 'old' end",
    "index_status": "case o_orderkey % 4 when 0 then 'stale' when 1 then 'reprocessing' else 'current' end",
    "run_id": "case when o_orderkey % 9 = 0 then o_custkey % 3 end",
}

#: Transcripts of requests: one row per event whose bodies are kept.
TRANSCRIPTS = {
    "id": "event_id",
    "created_at": "ts",
    "session_id": "case when k % 5 > 0 then concat('s', cast(k % 4 as string)) end",
    "request_body": "case when k % 3 > 0 then concat(case when event_id % 2 = 0 then 'What is  Café' else 'what is cafe' end, ' no. ', cast(k as string), '?') end",
    "response_body": "concat('answer ', event_type)",
    "distilled_at": "case when k % 4 = 0 then ts end",
}


def documents_of_connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*(F.expr(e).alias(c) for c, e in DOCUMENTS.items()))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return events.select(*(F.expr(e).alias(c) for c, e in TRANSCRIPTS.items()))


SQL_DOCUMENTS = "d as (select " + ", ".join(f"{_duck(e)} as {c}" for c, e in DOCUMENTS.items()) + " from orders)"
SQL_TRANSCRIPTS = (
    "t as (select " + ", ".join(f"{_duck(e)} as {c}" for c, e in TRANSCRIPTS.items())
    + " from (select *, cast(json_extract_string(props, '$.k') as int) as k from events))"
)
