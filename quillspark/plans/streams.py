"""Registered queries whose answers come from streams with state; tables go through them in micro-batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.plans.findings import rule_events
from quillspark.plans.registry import query
from quillspark.sources.shared import shared_folder
from quillspark.sources.tables import table
from quillspark.streaming import distiller, frames, replayed, rules


def late(at: str, key: str, seconds: int):
    """When a row arrives: up to `seconds` after its time, as its key says."""
    return F.expr(f"{at} + make_dt_interval(0, 0, 0, pmod(xxhash64({key}), {seconds}))")


#: Fixed value: events of a micro-batch, on the average.
EVENTS_A_BATCH = 500_000


@query(None)
def limiter_rules_stream(spark, sf):
    """Decisions of the limiter of several rules over a stream that comes up to six hours out of order."""
    events = rule_events(spark, sf).selectExpr("event_id", "gateway_id", "timestamp_seconds(at) as ts", "kind", "holder", f"cast(rules as {rules.RULE}) as rules")
    end = events.agg(F.max("ts").alias("ts")).selectExpr("-1L as event_id", "-1L as gateway_id", "ts + interval 30 days as ts", "'settle' as kind", "'' as holder", f"cast(array() as {rules.RULE}) as rules")
    # What a gateway holds is a batch's events and those of the hours before, so batches are as many as the table is long.
    batches = max(4, -(-events.count() // EVENTS_A_BATCH))
    return replayed.replayed(events, lambda s: rules.limited(s, "7 hours"), late("ts", "event_id", 6 * 3600), batches, end)


#: Characters of a frame, and the bound of a completion.
PIECE, MOST = 40, 1500


def completion_frames(spark, sf):
    """Frames of the turns of conversations, in pieces of PIECE characters; every ninth turn lacks its last frames and every eleventh one in the middle."""
    turns = table(spark, sf, "conversations").selectExpr("conv_id * 1000 + turn as request_id", "turn", "coalesce(text, '') as text", "timestamp_seconds(1700000000 + conv_id * 10 + turn) as began")
    pieces = turns.selectExpr("*", f"sequence(0, int(length(text) div {PIECE})) as seqs")
    rows = pieces.selectExpr("request_id", "began", "size(seqs) as n", f"posexplode(transform(seqs, i -> substring(text, 1 + i * {PIECE}, {PIECE}))) as (seq, content)")
    rows = rows.where("not (request_id % 9 = 0 and seq >= n - 2) and not (request_id % 11 = 0 and seq = 1)")
    return rows.selectExpr("request_id", "began + make_dt_interval(0, 0, 0, seq / 10) as ts", "bigint(seq) as seq", "content", "seq = n - 1 as last", "case when seq = n - 1 then bigint(n * 7) end as usage")


@query(
    f"""with t as (select conv_id * 1000 + turn as request_id, coalesce(text, '') as text, cast(length(coalesce(text, '')) // {PIECE} as bigint) + 1 as n from conversations),
c as (select *, least(case when request_id % 9 = 0 then greatest(n - 2, 0) else n end, case when request_id % 11 = 0 and n > 1 then 1 else n end) as frames from t)
select request_id, left(left(text, cast(frames * {PIECE} as integer)), {MOST}) as text, frames, least(length(text), frames * {PIECE}) > {MOST} as truncated, frames = n as complete,
  case when request_id % 9 <> 0 and not (request_id % 11 = 0 and n = 2) then n * 7 end as usage
from c where not (request_id % 9 = 0 and n <= 2) and not (request_id % 99 = 0 and n <= 3 and false)"""
)
def stream_completions(spark, sf):
    """Completions put together from frames that come up to twenty seconds out of order."""
    sent = completion_frames(spark, sf)
    end = sent.agg(F.max("ts").alias("ts")).selectExpr("-1L as request_id", "ts + interval 1 days as ts", "0L as seq", "'' as content", "true as last", "cast(null as bigint) as usage")
    return replayed.replayed(sent, lambda s: frames.completions(s, MOST, 30, delay="30 seconds"), late("ts", "request_id, seq", 20), 4, end).where("request_id >= 0")


def transcripts(spark, sf):
    """Turns of conversations as transcripts of users; some turns come long after the one before."""
    return table(spark, sf, "conversations").selectExpr(
        "conv_id * 1000 + turn as log_id", "conv_id % 40 as end_user_id", "concat('c', conv_id) as session_id",
        "timestamp_seconds(1700000000 + (conv_id % 97) * 1800 + turn * 60 + case when turn >= 3 and conv_id % 3 = 0 then 4000 else 0 end) as ts", "text",
    )


QUIET, LEAST, DAILY = 900, 400, 2


def fact_rows(passes_):
    """One fact a pass: the longest word its user said, and the newest transcript as its source; a stand-in for a model's reply."""
    words = F.array_distinct(F.flatten(F.transform("transcripts", lambda t: F.split(F.lower(F.coalesce(t["text"], F.lit(""))), "[^a-z]+"))))
    first = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))[0]["w"]
    return passes_.select("end_user_id", first.alias("fact"), F.element_at("log_ids", -1).alias("source_log_id"))


FACT = "end_user_id bigint, fact string, source_log_id bigint"


@query(
    f"""with t as (select conv_id, turn, conv_id * 1000 + turn as log_id, conv_id % 40 as end_user_id, 'c' || conv_id as session_id, coalesce(text, '') as text,
  1700000000 + (conv_id % 97) * 1800 + turn * 60 + case when turn >= 3 and conv_id % 3 = 0 then 4000 else 0 end as secs from conversations),
g as (select *, case when secs - lag(secs) over w > {QUIET} then 1 else 0 end as cut from t window w as (partition by session_id order by secs, log_id)),
i as (select *, sum(cut) over (partition by session_id order by secs, log_id rows between unbounded preceding and current row) as island from g),
p as (select end_user_id, session_id, (max(secs) + {QUIET}) * 1000 as due_ms, count(*) as transcripts, max(log_id) as source_log_id, sum(length(trim(text))) as chars from i group by end_user_id, session_id, island),
j as (select *, row_number() over (partition by end_user_id, due_ms // 86400000, chars >= {LEAST} order by due_ms, session_id) as place from p),
w as (select p.end_user_id, p.session_id, p.due_ms, unnest(string_split_regex(lower(i.text), '[^a-z]+')) as w from p join i on i.session_id = p.session_id and i.log_id <= p.source_log_id and i.secs * 1000 + {QUIET} * 1000 <= p.due_ms and i.island = (select max(island) from i x where x.log_id = p.source_log_id)),
f as (select end_user_id, session_id, due_ms, min_by(w, (-length(w), w)) as fact from w group by all)
select end_user_id, session_id, due_ms, transcripts, cast(chars as bigint) as chars,
  case when chars < {LEAST} then 'too_short' when place > {DAILY} then 'over_cap' else 'succeeded' end as outcome, case when chars >= {LEAST} and place <= {DAILY} then fact end as fact
from j left join f using (end_user_id, session_id, due_ms)"""
)
def distilled_passes(spark, sf):
    """Passes over quiet sessions with their outcomes, and the fact each has committed."""
    rows = transcripts(spark, sf)
    end = rows.agg(F.max("ts").alias("ts")).selectExpr("-1L as log_id", "-1L as end_user_id", "'' as session_id", "ts + interval 1 days as ts", "'' as text")
    root = shared_folder(spark, "distiller")
    found = replayed.replayed(rows, lambda s: distiller.passes(s, QUIET, "20 minutes"), late("ts", "log_id", 600), 4, end)
    # The passes are a table here; as a stream they are committed in batches of their own.
    found.where("end_user_id >= 0").repartition(2, F.floor(F.col("due_ms") / 86_400_000)).write.parquet(f"{root}/passes")
    session = replayed.own_session(spark)
    stream = session.readStream.schema(found.schema).parquet(f"{root}/passes")
    distiller.distil(stream, f"{root}/out", f"{root}/state", fact_rows, LEAST, DAILY).awaitTermination()
    told, facts = distiller.marks(spark, f"{root}/out"), distiller.facts(spark, f"{root}/out", FACT)
    last = F.element_at("log_ids", -1)
    return told.withColumn("source_log_id", last).join(facts.drop("batch", "end_user_id"), "source_log_id", "left").select("end_user_id", "session_id", "due_ms", F.size("log_ids").cast("bigint").alias("transcripts"), "chars", "outcome", "fact")
