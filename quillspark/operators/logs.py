"""Joins of the request log with its transcripts, and what evaluation and memory take from them.

Logs and transcripts meet on (id, created_at): both are pruned to the window first, and
both keys make the join's, so a log partitioned by day is read by day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["id", "created_at"]


def within(start: str, end: str) -> Column:
    """created_at in the half-open window."""
    at = F.col("created_at")
    return (at >= F.lit(start).cast("timestamp_ntz")) & (at < F.lit(end).cast("timestamp_ntz"))


def of_session(session_id: str | None) -> Column:
    """Rows of one session; None is those without one."""
    return F.col("session_id").eqNullSafe(F.lit(session_id).cast("string"))


def retrieval_questions(requests: DataFrame, transcripts: DataFrame, limit: int | None = None, uncited: bool | None = None) -> DataFrame:
    """Logged requests that retrieved something and whose question was kept, the newest `limit` or all; optionally cited or uncited ones."""
    rows = requests.where("n_retrieved > 0")
    if uncited is not None:
        rows = rows.where("n_cited = 0" if uncited else "n_cited > 0")
    asked = rows.join(transcripts.where("request_body is not null"), KEY)
    return asked if limit is None else asked.orderBy(F.desc("id")).limit(limit)


def log_detail(requests: DataFrame, transcripts: DataFrame, log_id: int) -> DataFrame:
    """One request with its transcript, if that was kept."""
    return requests.where(F.col("id") == log_id).join(transcripts.where(F.col("id") == log_id), KEY, "left")


def distillable(policy_on: Column, end_user_id: Column, status_code: Column, request_body: Column) -> Column:
    return policy_on & end_user_id.isNotNull() & (status_code < 400) & request_body.isNotNull()


def _undistilled(requests: DataFrame, transcripts: DataFrame) -> DataFrame:
    return requests.where("status_code < 400").join(transcripts.where("distilled_at is null"), KEY)


def pending(requests: DataFrame, transcripts: DataFrame, limit: int) -> DataFrame:
    """The oldest undistilled transcripts of successful requests of each user and session, at most `limit` of each."""
    w = Window.partitionBy("end_user_id", "session_id").orderBy("created_at", "id")
    rows = _undistilled(requests.where("end_user_id is not null"), transcripts).withColumn("place", F.row_number().over(w))
    return rows.where(F.col("place") <= limit)


def pending_sessions(requests: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Organization, user and session of what is still to be distilled, each once."""
    return _undistilled(requests.where("end_user_id is not null"), transcripts).select("organization_id", "end_user_id", "session_id").distinct()


def mark_distilled(transcripts: DataFrame, entries: DataFrame, at: Column) -> DataFrame:
    """Transcripts with distilled_at set where an entry names them by both keys."""
    named = entries.select(*KEY).distinct().withColumn("_named", F.lit(True))
    rows = transcripts.join(named, KEY, "left")
    return rows.withColumn("distilled_at", F.when(F.col("_named"), at).otherwise(F.col("distilled_at"))).drop("_named")


def prunable_bodies(requests: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Transcripts by gateway and day: rows and bytes that dropping their bodies frees."""
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    rows = transcripts.join(requests.select(*KEY, "gateway_id"), KEY)
    sized = rows.withColumn("bytes", size("request_body") + size("response_body"))
    return sized.groupBy("gateway_id", F.to_date("created_at").alias("day")).agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"))


def without_metadata(requests: DataFrame, gateway_id: int, day: str) -> DataFrame:
    """The log without one gateway's requests of one day."""
    gone = (F.col("gateway_id") == gateway_id) & (F.to_date("created_at") == F.lit(day).cast("date"))
    return requests.where(~F.coalesce(gone, F.lit(False)))


def effective_windows(body_days: Column, metadata_days: Column, body_ceiling: Column, metadata_ceiling: Column) -> tuple[Column, Column]:
    """A gateway's retention under the platform's ceilings: a null keeps for ever, so the other one counts; bodies go no later than metadata."""
    metadata = F.least(metadata_days, metadata_ceiling)
    return F.least(body_days, body_ceiling, metadata), metadata


def day_window(days: int, now: Column) -> tuple[Column, Column]:
    """`days` whole UTC days up to the next midnight."""
    end = F.date_add(F.to_date(now), 1)
    return F.date_sub(end, days), end


def normalise_question(text: Column) -> Column:
    """The key of equal questions: no accents, case, marks or runs of blanks."""
    marks = F.regexp_replace(F.lower(unaccented(text)), r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(marks, r"\s+", " "))


#: Latin letters with accents, and without them.
_MARKED, _BARE = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def unaccented(text: Column) -> Column:
    """Latin letters without their accents; combining marks go."""
    return F.regexp_replace(F.translate(text, _MARKED, _BARE), r"\p{Mn}", "")


def importable(questions: DataFrame, existing: DataFrame, limit: int) -> DataFrame:
    """Questions for an evaluation set: the newest of each normalised text that the set hasn't got, at most `limit`, newest first.

    questions: id, question, n_cited; existing: question.  A question without a letter or digit is left out.
    """
    keyed = questions.withColumn("key", normalise_question(F.col("question"))).where("key <> ''")
    new = keyed.join(existing.select(normalise_question(F.col("question")).alias("key")).distinct(), "key", "left_anti")
    best = new.groupBy("key").agg(F.max(F.struct("id", "question", "n_cited")).alias("q"))
    source = F.when(F.col("q.n_cited") > 0, "citation").otherwise("log")
    return best.select("key", "q.id", "q.question", source.alias("source")).orderBy(F.desc("id")).limit(limit)


def cited_labels(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """Labels of logged requests: their cited chunks among the retrieved ones, with the text of those that still exist."""
    each = requests.select("id", F.explode(F.array_intersect("retrieved", "cited")).alias("chunk_id"))
    return each.join(chunks.select("chunk_id", "text"), "chunk_id", "left").select("id", "chunk_id", "text")


def expired_facts(facts: DataFrame, now: Column, limit: int) -> DataFrame:
    return facts.where(F.col("expires_at") < now).orderBy("fact_id").limit(limit)


def recent_facts(live: DataFrame, limit: int = 3, least: float = 0.8) -> DataFrame:
    """Each user's most recently seen live facts that are confident."""
    w = Window.partitionBy("end_user_id").orderBy(F.desc("last_seen_at"), F.desc("fact_id"))
    return live.where(F.col("confidence") >= least).withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def fact_counts(live: DataFrame) -> DataFrame:
    return live.groupBy("end_user_id").agg(F.count("*").alias("facts"))


def retryable(status_code: Column) -> Column:
    """Whether another target is worth trying."""
    return F.coalesce(status_code.isin(*RETRYABLE), F.lit(False))


#: States of an upstream after which another target is tried.
RETRYABLE = (408, 429, 500, 502, 503, 504)
