"""Registered queries over runs, snapshots, payloads, file types and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import payloads
from quillspark.functions.strings import folded
from quillspark.operators import filetypes, prompts, semantic, threads, upkeep
from quillspark.plans.registry import query
from quillspark.sources.tables import table

NOW = "2024-02-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _runs(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("run_id"),
        F.expr("timestamp_ntz '2024-01-31 00:00:00' + make_interval(0, 0, 0, 0, cast(c_custkey % 30 as int), 0, 0)").alias("started_at"),
        F.expr("case when c_custkey % 4 = 0 then timestamp_ntz '2024-01-31 00:00:00' end").alias("finished_at"),
        F.expr("case when c_custkey % 11 = 0 then c_custkey end").alias("reindex_run_id"),
        F.expr("c_custkey % 2").alias("failed"),
        F.expr("c_custkey % 3").alias("resumed"),
    )


@query(
    """with o as (select o_custkey, count(*) as owned from orders where o_orderstatus <> 'F' and o_orderkey % 5 = 0 group by 1)
select c_custkey as run_id, case when owned > 0 then 'continue' else 'close' end as action, coalesce(owned, 0) as owned,
  c_custkey % 3 + case when owned > 0 then 1 else 0 end as resumed, case when owned > 0 then 'running' when c_custkey % 2 = 0 then 'succeeded' else 'partial' end as status
from customer left join o on o_custkey = c_custkey where c_custkey % 4 <> 0 and c_custkey % 11 <> 0 and c_custkey % 30 <= 18"""
)
def runs_stalled(spark, sf):
    owned = table(spark, sf, "orders").where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("run_id"), (F.col("o_orderstatus") == "F").alias("finished"))
    return upkeep.stalled(_runs(spark, sf), owned, _now(), "6 hours")


@query(
    """select o_custkey as run_id, count(*) filter (o_orderstatus = 'F') as succeeded, count(*) filter (o_orderstatus = 'P') as failed, count(*) filter (o_orderstatus = 'O') as skipped,
  cast(sum(o_orderkey % 100) as bigint) as tokens from orders group by 1"""
)
def runs_reprocessed(spark, sf):
    outcome = F.expr("case o_orderstatus when 'F' then 'succeeded' when 'P' then 'failed' else 'skipped' end")
    return upkeep.reprocessed(table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), outcome.alias("outcome"), F.expr("o_orderkey % 100").alias("tokens")))


@query(
    """with r as (select o_custkey as run_id, case o_orderkey % 5 when 0 then 'chunking' when 1 then 'tokenizer' when 2 then 'unrecorded' when 3 then 'extractor' else 'weather' end as reason from orders),
n as (select run_id, reason, count(*) as n from r group by all)
select run_id, coalesce(first(reason order by n desc, reason) filter (reason in ('chunking', 'tokenizer', 'extractor')), 'manual') as "trigger" from n group by 1"""
)
def runs_trigger(spark, sf):
    reason = F.expr("case o_orderkey % 5 when 0 then 'chunking' when 1 then 'tokenizer' when 2 then 'unrecorded' when 3 then 'extractor' else 'weather' end")
    return upkeep.trigger(table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), reason.alias("reason")))


@query(
    f"""with s as (select o_custkey as run_id, cast(sum(o_orderkey % 3) as bigint) as done, cast(sum(4) as bigint) as total, 3600 * (o_custkey % 7) as elapsed from orders group by o_custkey)
select run_id, done, total, case when done > 0 and elapsed > 0 then cast(floor((total - done) * elapsed / done) as bigint) end as eta_seconds from s"""
)
def runs_progress(spark, sf):
    started = F.expr(f"timestamp_ntz '{NOW}' - make_interval(0, 0, 0, 0, cast(o_custkey % 7 as int), 0, 0)")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), F.expr("o_orderkey % 3").alias("done_points"), F.lit(4).alias("total_points"), started.alias("started_at"))
    return upkeep.progress(rows, _now())


@query(
    """select c_custkey as collection, case when c_custkey % 10 < c_custkey % 12 - 2 then 'too few points' when c_custkey % 12 = 0 then null when c_custkey % 5 = 0 then 'other width'
  when c_custkey % 6 = 1 then 'search finds nothing' end as fault from customer"""
)
def index_swap_faults(spark, sf):
    made = {"collection": "c_custkey", "points": "c_custkey % 10", "expected": "c_custkey % 12", "width": "case when c_custkey % 5 = 0 then 64 else 256 end", "model_width": "256", "found": "case when c_custkey % 6 = 1 then 0 else 1 end"}
    return upkeep.swap_faults(table(spark, sf, "customer").select(*(F.expr(e).alias(c) for c, e in made.items())), 2)


@query(
    f"""select o_custkey as connector_id, count(*) as stale, round(date_diff('second', min(o_orderdate)::timestamp, timestamp '{NOW}') / 3600, 1) as age_hours from orders group by 1
having date_diff('second', min(o_orderdate)::timestamp, timestamp '{NOW}') / 3600 >= 230000"""
)
def index_stale_alerts(spark, sf):
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("connector_id")).agg(F.count("*").alias("stale"), F.min(F.col("o_orderdate").cast("timestamp_ntz")).alias("oldest"))
    return upkeep.stale_alerts(rows, _now(), 230000)


@query("select o_custkey as subject_id, cast(sum(o_orderkey % 4) as bigint) as removed, bool_and(o_orderkey % 9 <> 0) as complete from orders group by 1")
def erasure_report(spark, sf):
    return upkeep.erasure(table(spark, sf, "orders").select(F.col("o_custkey").alias("subject_id"), F.expr("o_orderkey % 4").alias("removed"), F.expr("o_orderkey % 9 <> 0").alias("complete")))


@query(
    """with b as (select c_custkey as subject_id, unnest(['name', 'phone', 'segment']) as path, unnest([c_name, c_mktsegment, null]) as before from customer where c_custkey % 7 > 0),
a as (select c_custkey as subject_id, unnest(['name', 'phone', 'city']) as path, unnest([case when c_custkey % 3 = 0 then 'x' else c_name end, c_mktsegment, null]) as after from customer where c_custkey % 5 > 0),
d as (select coalesce(b.subject_id, a.subject_id) as subject_id, coalesce(b.path, a.path) as path, before, after from b full join a on a.subject_id = b.subject_id and a.path = b.path
  where not (b.path is not null and a.path is not null and before is not distinct from after))
select subject_id, path, before, after, greatest(count(*) over (partition by subject_id) - 2, 0) as omitted from d qualify row_number() over (partition by subject_id order by path) <= 2"""
)
def audit_changes(spark, sf):
    people = table(spark, sf, "customer").withColumn("subject_id", F.col("c_custkey"))
    before = people.where("c_custkey % 7 > 0").select("subject_id", F.expr("map('name', c_name, 'phone', c_mktsegment, 'segment', null)").alias("fields"))
    after = people.where("c_custkey % 5 > 0").select("subject_id", F.expr("map('name', case when c_custkey % 3 = 0 then 'x' else c_name end, 'phone', c_mktsegment, 'city', null)").alias("fields"))
    return upkeep.changes(before, after, "subject_id", most=2)


@query("select o_custkey as run_id, count(*) as n, list(o_orderkey order by o_orderkey)[1:5] as sample from orders group by 1")
def audit_sampled(spark, sf):
    return upkeep.sampled(table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), "o_orderkey"), "run_id", "o_orderkey")


@query(
    """select o_custkey as set_id, count(*) as total, count(*) filter (o_orderkey % 2 = 0) as verified, count(*) filter (o_orderkey % 3 = 0) as generated,
  count(*) filter (o_orderkey % 4 = 0 and o_orderkey % 5 = 0) as negatives from orders group by 1"""
)
def evaluation_item_counts(spark, sf):
    items = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("set_id"),
        F.expr("o_orderkey % 2 = 0").alias("verified"),
        F.expr("case when o_orderkey % 3 = 0 then 'generated' else 'manual' end").alias("source"),
        F.expr("if(o_orderkey % 4 = 0, array(), array(1))").alias("relevant"),
        F.expr("if(o_orderkey % 5 = 0, array(), array(1))").alias("relevant_document_ids"),
    )
    return upkeep.item_counts(items)


@query("select o_custkey, o_orderkey, o_orderdate from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) <= 3")
def evaluation_newest_runs(spark, sf):
    return upkeep.newest(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey", 3)


@query(
    """with d as (select *, row_number() over (partition by connector_id order by document_id) as n from (select o_custkey % 25 as connector_id, o_orderkey as document_id from orders)),
l as (select document_id, row_number() over (order by connector_id, document_id) - 1 as rank, count(*) over () as total from d where n <= 40),
u as (select l_orderkey as document_id, l_orderkey * 10 + l_linenumber as chunk_id, row_number() over (partition by l_orderkey order by l_linenumber) - 1 as i, count(*) over (partition by l_orderkey) as n
  from lineitem where l_quantity >= 20 and (l_orderkey * 10 + l_linenumber) % 9 <> 0)
select chunk_id, document_id from l join u using (document_id) where i = n // 2 order by rank % greatest(1, total // 60), rank limit 60"""
)
def evaluation_candidate_chunks(spark, sf):
    documents = table(spark, sf, "orders").select(F.expr("o_custkey % 25").alias("connector_id"), F.col("o_orderkey").alias("document_id"))
    chunks = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.expr("l_orderkey * 10 + l_linenumber").alias("chunk_id"), F.col("l_linenumber").alias("chunk_index"), F.col("l_quantity").alias("token_count")
    )
    return upkeep.candidate_chunks(documents, chunks, chunks.where("chunk_id % 9 = 0").select("chunk_id"), 60, 20, 40)


_FOLD = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"


@query(
    f"""select d.doc_id as label_id, coalesce(contains({_FOLD.format("c.text")}, {_FOLD.format("substring(d.text, 1, 40 + (d.doc_id % 3)::int * 10)")}), false) as holds
from documents d left join (select * from documents where doc_id % 5 > 0) c on c.doc_id = case when d.doc_id % 2 = 0 then d.doc_id else d.doc_id + 1 end"""
)
def evaluation_still_holds(spark, sf):
    docs = table(spark, sf, "documents")
    labels = docs.select(F.col("doc_id").alias("label_id"), F.expr("substring(text, 1, 40 + cast(doc_id % 3 as int) * 10)").alias("label"), F.expr("if(doc_id % 2 = 0, doc_id, doc_id + 1)").alias("chunk_id"))
    return upkeep.still_holds(labels, docs.where("doc_id % 5 > 0").select(F.col("doc_id").alias("chunk_id"), "text"), folded)


def _derived_sql() -> str:
    cases = [f"when {'' if of is None else f'dialect = {chr(39)}{of}{chr(39)} and '}(starts_with(whole, '{p}') or starts_with(bare, '{p}')) then '{name}'" for of, p, name in sorted(payloads.TOKENIZERS, key=lambda r: -len(r[1]))]
    return f"case {' '.join(cases)} else 'approximate' end"


_MODELS = "['gpt-4o-mini', ' OpenAI/GPT-4.1', 'gpt-4-turbo', 'vendor/claude-x', 'opus', 'llama-3', 'text-davinci-003', 'o3']"


@query(
    f"""with m as (select event_id, case event_id % 3 when 0 then 'openai' when 1 then 'anthropic' else 'other' end as dialect, {_MODELS}[event_id % 8 + 1] as model from events),
w as (select *, lower(trim(model)) as whole, split_part(lower(trim(model)), '/', -1) as bare from m)
select event_id, {_derived_sql()} as tokenizer from w"""
)
def model_tokenizers(spark, sf):
    dialect = F.expr("case event_id % 3 when 0 then 'openai' when 1 then 'anthropic' else 'other' end")
    model = F.expr(f"array({_MODELS[1:-1]})[cast(event_id % 8 as int)]")
    return table(spark, sf, "events").select("event_id", payloads.derived_tokenizer(dialect, model).alias("tokenizer"))


@query(
    """with p as (select event_id, case when event_id % 3 = 0 then ' about ' || event_type || ' ' when event_id % 3 = 1 then '' end as context, case when event_id % 2 = 0 then 'window ' || event_id when event_id % 5 = 0 then '' end as embedded, props as text from events)
select event_id, case when coalesce(context, '') <> '' then trim(context) || chr(10) || chr(10) else '' end || coalesce(nullif(embedded, ''), text, '') as input,
  cast(greatest(20, floor((event_id % 200) * 0.75)) as bigint) as words from p"""
)
def point_inputs(spark, sf):
    context = F.expr("case when event_id % 3 = 0 then concat(' about ', event_type, ' ') when event_id % 3 = 1 then '' end")
    embedded = F.expr("case when event_id % 2 = 0 then concat('window ', event_id) when event_id % 5 = 0 then '' end")
    return table(spark, sf, "events").select("event_id", payloads.embedding_input(context, embedded, F.col("props")).alias("input"), payloads.words_for(F.col("event_id") % 200).alias("words"))


@query()
def point_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", payloads.point_id(F.col("doc_id"), F.col("n_chars") % 7).alias("point_id"))


_HEADS = [h for h, _ in filetypes.SIGNATURES] + [m for m, _ in filetypes.MARKS] + ["0000001866747970" + b for b in filetypes.BRANDS] + ["000000186674797069736F6D", "", "41004200", "4101020304", "414243440A"]
_NAMES = ["a.docx", "b.tar.gz", "c.PY", "dir.d/noext", "e.csv", ".hpp", "f.json", "g.epub", "h.yaml"]


def _sniffed_sql() -> str:
    from_ext = " ".join(f"when ext in ({', '.join(repr(x) for x in s.split())}) then '{t}'" for t, s in filetypes.TEXT_TYPES.items())
    zipped = " ".join(f"when ext = '{s}' then '{t}'" for s, t in filetypes.CONTAINERS.items())
    signed = " ".join(f"when starts_with(h, '{m}') then " + (f"case {zipped} else '{t}' end" if t == "application/zip" else f"'{t}'") for m, t in filetypes.SIGNATURES)
    brands = " ".join(f"when substring(h, 17, 8) = '{b}' then '{t}'" for b, t in filetypes.BRANDS.items())
    bom = " or ".join(f"starts_with(h, '{m}')" for m, _ in filetypes.MARKS)
    encodings = " ".join(f"when starts_with(h, '{m}') then '{e}'" for m, e in filetypes.MARKS)
    heads, names = ", ".join(f"'{h}'" for h in _HEADS), ", ".join(f"'{n}'" for n in _NAMES)
    return f"""with f as (select event_id, [{heads}][event_id % {len(_HEADS)} + 1] || case when event_id % 2 = 0 then hex(encode(props)) else '' end as h, [{names}][(event_id // {len(_HEADS)}) % {len(_NAMES)} + 1] as name from events),
b as (select *, lower(regexp_extract(name, '\\.([^./]+)$', 1)) as ext, [substring(h, 2 * i + 1, 2) for i in range(0, length(h) // 2)] as bytes from f),
t as (select *, h = '' or {bom} or (not list_contains(bytes, '00') and len([x for x in bytes if x < '20' and x not in ('09', '0A', '0C', '0D', '1B')]) < 0.02 * len(bytes)) as is_text from b)
select event_id, case {signed} when length(h) >= 24 and substring(h, 9, 8) = '66747970' then case {brands} else 'video/mp4' end when is_text then case {from_ext} else 'text/plain' end
  else 'application/octet-stream' end as media_type, is_text as text, case {encodings} end as encoding from t"""


@query(_sniffed_sql())
def file_types(spark, sf):
    pick = lambda values, at: F.get(F.array(*(F.lit(v) for v in values)), at.cast("int"))
    n = len(_HEADS)
    head = F.concat(F.unhex(pick(_HEADS, F.col("event_id") % n)), F.when(F.col("event_id") % 2 == 0, F.encode("props", "UTF-8")).otherwise(F.lit(b"")))
    named = table(spark, sf, "events").select("event_id", head.alias("head"), pick(_NAMES, F.floor(F.col("event_id") / n) % len(_NAMES)).alias("name"))
    return named.select(
        "event_id",
        filetypes.sniff(F.col("head"), F.col("name")).alias("media_type"),
        filetypes.looks_like_text(F.col("head")).alias("text"),
        filetypes.bom_encoding(F.col("head")).alias("encoding"),
    )


@query(
    """with c as (select conv_id, turn, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text from conversations),
f as (select *, row_number() over (partition by conv_id, role, text order by turn) as seen from c where role in ('user', 'assistant') and text <> ''),
k as (select *, sum(length(text) + length(role) + 2) over w as used, row_number() over w as back from f where seen = 1 window w as (partition by conv_id order by turn desc)),
b as (select *, coalesce(min(case when used > 900 and back > 1 then back end) over (partition by conv_id), 1000000) as stop from k)
select conv_id, count(*) as n_turns, sha256(string_agg(role || ':' || text, '|' order by turn)) as turns_sha256 from b where back < stop group by 1"""
)
def thread_exchanges(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.array(F.struct("role", "text")).alias("said"))
    each = rows.select("conv_id", "turn", threads.turns_of(F.col("said"), F.lit(None).cast("string")).alias("turns"))
    out = threads.exchanges(each, ["conv_id"], "turn", budget=900).where(F.size("turns") > 0)
    joined = F.array_join(F.transform("turns", lambda t: F.concat_ws(":", t["role"], t["text"])), "|")
    return out.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"))


@query()
def text_excerpts(spark, sf):
    return threads.excerpts(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), 120)


@query()
def evaluation_reanchored(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null")
    pieces = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    chunks = pieces.select(F.concat_ws(":", "doc_id", "chunk_index").alias("chunk_id"), F.col("doc_id").alias("document_id"), "chunk_index", "text")
    labels = docs.select(F.col("doc_id").alias("label_id"), F.col("doc_id").alias("document_id"), F.substring("text", 30, 160).alias("text"))
    return threads.reanchored(labels, chunks)


@query()
def text_chunks_semantic(spark, sf):
    return semantic.chunks(table(spark, sf, "documents").select("doc_id", F.lit(0).alias("section"), "text"), 200, percentile=90, floor=40)


@query("select doc_id % 5 as organization_id, count(*) as points, cast(floor(count(*) * coalesce(avg(length(text)), 0) / 4) as bigint) as tokens from documents group by 1")
def index_reindex_estimate(spark, sf):
    return upkeep.reindex_estimate(table(spark, sf, "documents").select(F.expr("doc_id % 5").alias("organization_id"), "text"))


@query(
    """select event_id, case when event_id % 7 = 0 or event_id % 8 >= 5 then 'dead' else 'retry' end as action,
  case when event_id % 7 = 0 then event_type || chr(10) || 'x' when event_id % 8 >= 5 then 'failed after ' || event_id % 8 || ' attempts: ' || event_type end as reason,
  case when event_id % 7 <> 0 and event_id % 8 < 5 then least(2.0 * power(2, greatest(0, event_id % 8 - 1)), 10.0) end as ceiling_seconds from events"""
)
def job_retries(spark, sf):
    error = F.concat("event_type", F.lit("\nx"))
    decided = payloads.retry_decision(F.col("event_id") % 8, F.col("event_id") % 7 == 0, error, cap_seconds=10.0)
    return table(spark, sf, "events").select("event_id", decided.alias("d")).select("event_id", "d.*")


_SAID = "'Told in [' || event_id % 7 || '] and [9] twice.'"


@query(
    f"""select event_id as id, '> ' || case when event_id % 3 = 0 then {_SAID} else case when event_id % 7 between 1 and 4 then replace({_SAID}, '[9]', '') else replace(replace({_SAID}, '[9]', ''), '[' || event_id % 7 || ']', '') end
  || case when event_id % 2 = 0 then chr(10) || 'S' else '' end end as text, cast(null as int[]) as citations, cast(null as int[]) as unresolved from events"""
)
def citation_delivered(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.expr("concat('Told in [', event_id % 7, '] and [9] twice.')").alias("text"), F.expr("if(event_id % 3 = 0, 0, 4)").alias("injected"), F.expr("if(event_id % 2 = 0, '\nS', null)").alias("footer"))
    return prompts.delivered(rows.join(prompts.resolved(rows).select("id", "cited", "unresolved", "spans"), "id"), "footer", prefix=F.lit("> "))
