"""Registered queries that join the request log with transcripts, and those of facts and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import strings
from quillspark.operators import logs, memory
from quillspark.plans.queries import _FACTS, NOW, _facts
from quillspark.plans.registry import query
from quillspark.sources.tables import SQL_REQUESTS, SQL_TRANSCRIPTS, requests, table, transcripts

RT = f"with {SQL_REQUESTS}, {SQL_TRANSCRIPTS}"
START, END = "2024-01-05", "2024-01-20"
IN = f"r.created_at >= timestamp '{START}' and r.created_at < timestamp '{END}'"
BOTH = "r join t on t.id = r.id and t.created_at = r.created_at"


def _within(spark, sf):
    return requests(spark, sf).where(logs.within(START, END)), transcripts(spark, sf).where(logs.within(START, END))


@query(f"{RT} select r.id, request_body, n_cited from {BOTH} where {IN} and n_retrieved > 0 and request_body is not null and n_cited = 0 order by r.id desc limit 200")
def log_retrieval_questions(spark, sf):
    return logs.retrieval_questions(*_within(spark, sf), 200, uncited=True).select("id", "request_body", "n_cited")


@query(f"{RT} select r.id, status_code, request_body from r left join t on t.id = r.id and t.created_at = r.created_at where {IN} and r.id = 77")
def log_detail(spark, sf):
    return logs.log_detail(*_within(spark, sf), 77).select("id", "status_code", "request_body")


@query(f"{RT} select r.id, session_id from {BOTH} where {IN} and session_id is null")
def log_without_session(spark, sf):
    rows, said = _within(spark, sf)
    return rows.join(said.where(logs.of_session(None)), logs.KEY).select("id", "session_id")


@query(f"{RT} select r.id, end_user_id is not null and status_code < 400 and request_body is not null and gateway_id <> 1 as distillable from {BOTH} where {IN}")
def log_distillable(spark, sf):
    rows, said = _within(spark, sf)
    wanted = logs.distillable(F.col("gateway_id") != 1, F.col("end_user_id"), F.col("status_code"), F.col("request_body"))
    return rows.join(said, logs.KEY).select("id", wanted.alias("distillable"))


@query(
    f"""{RT} select r.id, end_user_id, session_id, row_number() over (partition by end_user_id, session_id order by r.created_at, r.id) as place from {BOTH}
where {IN} and status_code < 400 and distilled_at is null and end_user_id is not null qualify place <= 2"""
)
def log_pending(spark, sf):
    return logs.pending(*_within(spark, sf), 2).select("id", "end_user_id", "session_id", "place")


@query(f"{RT} select distinct organization_id, end_user_id, session_id from {BOTH} where {IN} and status_code < 400 and distilled_at is null and end_user_id is not null")
def log_pending_sessions(spark, sf):
    return logs.pending_sessions(*_within(spark, sf))


@query(f"{RT} select id, case when id % 3 = 0 then timestamp '2024-03-01' else distilled_at end as distilled_at from t")
def log_mark_distilled(spark, sf):
    said = transcripts(spark, sf)
    return logs.mark_distilled(said, said.where("id % 3 = 0"), F.lit("2024-03-01").cast("timestamp_ntz")).select("id", "distilled_at")


@query(f"{RT} select gateway_id, cast(r.created_at as date) as day, count(*) as rows, cast(sum(coalesce(strlen(request_body), 0) + coalesce(strlen(response_body), 0)) as bigint) as bytes from {BOTH} group by 1, 2")
def log_prunable_bodies(spark, sf):
    return logs.prunable_bodies(requests(spark, sf), transcripts(spark, sf))


@query(f"{RT} select gateway_id, cast(created_at as date) as day, count(*) as requests from r where not (gateway_id = 1 and cast(created_at as date) = date '2024-01-09') group by 1, 2")
def log_prune_metadata(spark, sf):
    left = logs.without_metadata(requests(spark, sf), 1, "2024-01-09")
    return left.groupBy("gateway_id", F.to_date("created_at").alias("day")).agg(F.count("*").alias("requests"))


@query("select c_custkey, least(nullif(c_custkey % 40, 0), 30, least(nullif(c_custkey % 50, 0), 45)) as body_days, least(nullif(c_custkey % 50, 0), 45) as metadata_days from customer")
def log_effective_windows(spark, sf):
    days = lambda n: F.expr(f"nullif(c_custkey % {n}, 0)")
    bodies, metadata = logs.effective_windows(days(40), days(50), F.lit(30), F.lit(45))
    return table(spark, sf, "customer").select("c_custkey", bodies.alias("body_days"), metadata.alias("metadata_days"))


@query(f"{RT} select count(*) as calls from r where created_at >= timestamp '2024-01-15' and created_at < timestamp '2024-01-22' and model_name is not null")
def log_calls_since(spark, sf):
    start, end = logs.day_window(7, F.lit("2024-01-21 13:00:00").cast("timestamp_ntz"))
    return requests(spark, sf).where((F.col("created_at") >= start) & (F.col("created_at") < end) & F.col("model_name").isNotNull()).agg(F.count("*").alias("calls"))


def _normal(text: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(strip_accents({text})), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(
    f"""{RT}, q as (select r.id, request_body as question, n_cited, {_normal("request_body")} as key from {BOTH} where {IN} and n_retrieved > 0 and request_body is not null)
select key, id, question, case when n_cited > 0 then 'citation' else 'log' end as source from q where key <> '' and key not in (select {_normal("t.request_body")} from t where t.id % 50 = 0 and t.request_body is not null)
qualify row_number() over (partition by key order by id desc) = 1 order by id desc limit 500"""
)
def log_import_questions(spark, sf):
    found = logs.retrieval_questions(*_within(spark, sf)).select("id", F.col("request_body").alias("question"), "n_cited")
    return logs.importable(found, transcripts(spark, sf).where("id % 50 = 0 and request_body is not null").select(F.col("request_body").alias("question")), 500)


@query(
    """with l as (select l_orderkey as id, list(l_partkey) as retrieved, list(l_partkey) filter (l_returnflag = 'R') as cited from lineitem group by 1),
e as (select id, unnest(list_intersect(list_distinct(retrieved), coalesce(cited, []))) as chunk_id from l)
select id, chunk_id, p_name as text from e left join (select * from part where p_partkey % 3 > 0) on p_partkey = chunk_id"""
)
def log_cited_labels(spark, sf):
    lists = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_partkey").alias("retrieved"), F.expr("collect_list(l_partkey) filter (where l_returnflag = 'R')").alias("cited"))
    return logs.cited_labels(lists, table(spark, sf, "part").where("p_partkey % 3 > 0").selectExpr("p_partkey as chunk_id", "p_name as text"))


@query(f"select event_id as fact_id from events where event_id % 4 = 0 and ts + interval 20 days < timestamp '{NOW}' order by 1 limit 100")
def fact_expired(spark, sf):
    return logs.expired_facts(_facts(spark, sf), F.lit(NOW).cast("timestamp_ntz"), 100).select("fact_id")


@query(
    f"""{_FACTS} select end_user_id, fact_id, row_number() over (partition by end_user_id order by ts desc, fact_id desc) as place from f where live and confidence >= 0.8 qualify place <= 3"""
)
def fact_recent(spark, sf):
    return logs.recent_facts(_facts(spark, sf).where(memory.live(F.lit(NOW).cast("timestamp_ntz")))).select("end_user_id", "fact_id", "place")


@query(f"{_FACTS} select end_user_id, count(*) as facts from f where live group by 1")
def fact_counts(spark, sf):
    return logs.fact_counts(_facts(spark, sf).where(memory.live(F.lit(NOW).cast("timestamp_ntz"))))


@query(f"{RT} select id, status_code in (408, 429, 500, 502, 503, 504) as retryable from r")
def route_retryable(spark, sf):
    return requests(spark, sf).select("id", logs.retryable(F.col("status_code")).alias("retryable"))


_IMPERATIVE = ", ".join(f"'{w}'" for w in strings.IMPERATIVES)
_HOLDS = " or ".join(f"contains(lower(text), '{p}')" for p in strings.OVERRIDES)


@query(
    rf"""with w as (select conv_id, turn, text, regexp_extract_all(lower(text), '[a-z'']+') as w from conversations)
select conv_id, turn, regexp_matches(lower(text), '\b(you|your|yours|yourself|you''re|youre)\b') or {_HOLDS} or contains(text, '```') or contains(text, '<|') or contains(text, '|>')
  or coalesce(w[1] in ({_IMPERATIVE}) or (w[1] in ('always', 'never') and (len(w) < 2 or w[2] in ({_IMPERATIVE}) or not ends_with(w[2], 's'))), false) as instruction from w where text is not null"""
)
def fact_instructions(spark, sf):
    rows = table(spark, sf, "conversations").where("text is not null")
    return rows.select("conv_id", "turn", strings.reads_as_an_instruction(F.col("text")).alias("instruction"))


@query(r"select doc_id, regexp_matches(ltrim(text), '^\p{Ll}') as mid_sentence from documents where text is not null")
def text_mid_sentence(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.ltrim("text").rlike(r"^\p{Ll}").alias("mid_sentence"))


@query("select event_id, substring(trim(regexp_replace(props || chr(7) || event_type, '[\\x00-\\x1f\\x7f-\\x9f]', '', 'g')), 1, 200) as key, 'anon:' || substring(sha256(user_id::varchar || event_type), 1, 16) as anonymous from events")
def identity_keys(spark, sf):
    rows = table(spark, sf, "events")
    key = strings.clean_key(F.concat("props", F.lit("\x07"), "event_type"))
    return rows.select("event_id", key.alias("key"), strings.anonymous_id(F.col("user_id"), F.col("event_type")).alias("anonymous"))


@query("select event_id, case when event_id % 3 = 0 then 'h' || user_id when event_id % 3 = 1 then 'b' || user_id else 'anon:' || substring(sha256(user_id::varchar || 'ip'), 1, 16) end as identity from events")
def identity_resolved(spark, sf):
    header = F.expr("case when event_id % 3 = 0 then concat('h', user_id) end")
    body = F.expr("case when event_id % 3 <= 1 then concat('b', user_id) end")
    return table(spark, sf, "events").select("event_id", F.coalesce(header, body, strings.anonymous_id(F.col("user_id"), F.lit("ip"))).alias("identity"))


@query("select event_id, round(least(1.0, greatest(value / 100, value / 100 + (1 - value / 100) / 3, (event_id % 10) / 10)), 9) as confidence from events")
def fact_reinforced(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(strings.reinforced(F.col("value") / 100, F.expr("(event_id % 10) / 10")), 9).alias("confidence"))
