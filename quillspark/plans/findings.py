"""Registered queries of index findings, limiter rules and the memory pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import embedding
from quillspark.operators import findings, quotas, reconciliation
from quillspark.operators import metrics as metrics_ops
from quillspark.plans.registry import query
from quillspark.sources.tables import SQL_DOCUMENTS, SQL_REQUESTS, documents_of_connectors, requests, table

_POINTS = """p as (select l_orderkey % 5 as connector_id, case l_orderkey % 3 when 0 then 'markdown' when 1 then 'csv' else 'text' end as kind, l_orderkey as document_id, l_linenumber - 1 as chunk_index,
  l_partkey % (120 * (1 + l_orderkey % 5)) + cast(l_quantity as bigint) as token_count, case when (l_partkey + l_orderkey % 5) % 5 < 2 then ' and so on' else 'So it is' end as text, 'f' || (l_orderkey % 100 // 45) as fingerprint from lineitem)"""


def _points(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey % 5 as connector_id", "case l_orderkey % 3 when 0 then 'markdown' when 1 then 'csv' else 'text' end as kind", "l_orderkey as document_id", "l_linenumber - 1 as chunk_index",
        "l_partkey % (120 * (1 + l_orderkey % 5)) + cast(l_quantity as bigint) as token_count", "case when (l_partkey + l_orderkey % 5) % 5 < 2 then ' and so on' else 'So it is' end as text",
        "concat('f', l_orderkey % 100 div 45) as fingerprint",
    )


_TESTS = {
    "short_chunks": ("token_count < 40", "case when c * 1.0 / n >= 0.10 then 2 else 1 end"),
    "at_ceiling": ("token_count between 180 and 200", "case when c * 1.0 / n < 0.5 then 0 else 1 end"),
    "over_ceiling": ("token_count > 300", "2"),
    "mid_sentence_starts": ("kind in ('markdown', 'text') and chunk_index > 0 and text like ' and%'", "case when c * 1.0 / n >= 0.25 then 2 else 1 end"),
}
_FOUND = " union all ".join(
    f"select connector_id, kind, '{code}' as code, c, d, {rank} as r from (select connector_id, kind, count(*) as n, count(*) filter ({test}) as c, count(distinct document_id) filter ({test}) as d from p group by all) where c > 0"
    for code, (test, rank) in _TESTS.items()
)
_FOUND = f"""with {_POINTS}, g as (select connector_id, kind, document_id, count(*) as n from p group by all), x as ({_FOUND} union all
  select connector_id, kind, 'single_chunk_documents' as code, count(*) filter (n = 1) as c, count(*) filter (n = 1) as d, 1 as r from g group by connector_id, kind having count(*) filter (n = 1) > 0)"""
_SEVERITY = "['green', 'amber', 'red']"


@query(f'{_FOUND} select connector_id, kind, code, c as "count", d as documents, {_SEVERITY}[r + 1] as severity from x')
def finding_chunks(spark, sf):
    return findings.chunk_findings(_points(spark, sf), 200)


@query(f'{_FOUND} select connector_id, code, cast(sum(c) as bigint) as "count", cast(sum(d) as bigint) as documents, {_SEVERITY}[max(r) + 1] as severity from x group by all')
def finding_merged(spark, sf):
    return findings.merged(findings.chunk_findings(_points(spark, sf), 200))


@query(f"{_FOUND} select connector_id, {_SEVERITY}[max(r) + 1] as severity from x group by all")
def finding_worst(spark, sf):
    return findings.worst(findings.chunk_findings(_points(spark, sf), 200))


@query(f"with {_POINTS} select connector_id, document_id, count(*) as n, row_number() over (partition by connector_id order by count(*) desc, document_id) as place from p where token_count < 40 group by 1, 2 qualify place <= 10")
def finding_top_documents(spark, sf):
    return findings.top_documents(_points(spark, sf), F.col("token_count") < findings.FLOOR)


@query(
    f"""with {_POINTS}, t as (select connector_id, fingerprint, count(*) as n from p group by 1, 2), m as (select connector_id, count(*) as fingerprints, arg_min(fingerprint, (-n, fingerprint)) as main from t group by 1 having count(*) > 1)
select connector_id, fingerprints, count(*) as "count", count(distinct document_id) as documents from p join m using (connector_id) where fingerprint <> main group by 1, 2"""
)
def finding_mixed_fingerprints(spark, sf):
    return findings.mixed_fingerprints(_points(spark, sf))


_COSINES = "select p_partkey % 4 as model, case p_partkey % 4 when 0 then 1.0 - p_size / 2000.0 when 1 then case when p_partkey % 8 = 1 then 0.99 else 0.3 end when 2 then 0.5 + p_size / 1000.0 else p_size / 50.0 end as cosine from part"


@query(
    f"""with c as (select model, cast(cosine as double) as cosine from ({_COSINES})),
s as (select model, count(*) as sampled, avg(cosine) as mean, min(cosine) as low, max(cosine) as high, quantile_disc(cosine, 0.05) as p5, count(*) filter (cosine < 0.95) / count(*) as below from c group by 1)
select model, sampled, round(mean, 6) as mean, low, p5, round(below, 6) as below, case when below = 0 or (mean >= 0.95 and below < 0.05) then 'healthy' when below between 0.2 and 0.8 then 'bimodal' when below > 0.8 and high - low < 0.2 then 'offset' else 'low' end as shape from s"""
)
def finding_drift(spark, sf):
    model, cosine = _COSINES.removeprefix("select ").removesuffix(" from part").split(", ")
    return findings.drift(table(spark, sf, "part").selectExpr(model, cosine).withColumn("cosine", F.col("cosine").cast("double")))


@query(
    f"""with {SQL_DOCUMENTS} select id, case when index_fingerprint like 'ch=%' then array_to_string(list_filter([case when o_em <> 'm0' then 'embedding_model' end, case when o_ch <> '1' then 'chunking' end], lambda x: x is not null), ',') end as differences
from (select id, index_fingerprint, regexp_extract(index_fingerprint, 'em=(m\\d)', 1) as o_em, regexp_extract(index_fingerprint, 'ch=(\\d)', 1) as o_ch from d)"""
)
def finding_fingerprint_differences(spark, sf):
    found = findings.fingerprint_differences(F.col("index_fingerprint"), F.lit("ch=1;em=m0;tk=w;sm=n;xv=1"))
    return documents_of_connectors(spark, sf).select("id", F.array_join(found, ",").alias("differences"))


@query(
    f"""with {SQL_DOCUMENTS}, b as (select connector_id, count(*) as documents, max(index_fingerprint) as f from d where connector_id % 6 > 0 and id % 5 > 0 group by 1),
a as (select connector_id, count(*) as documents, case when connector_id % 5 = 1 then 'x' else max(index_fingerprint) end as f from d where connector_id % 7 > 0 and (connector_id % 4 > 0 or id % 3 > 0) and id % 5 > 0 group by 1)
select connector_id, case when b.documents is null then 'attached' when a.documents is null then 'detached' when a.f is distinct from b.f then 'recut' else 'documents' end as change,
  coalesce(a.documents, 0) - coalesce(b.documents, 0) as documents_delta from b full join a using (connector_id) where b.documents is null or a.documents is null or a.f is distinct from b.f or a.documents <> b.documents"""
)
def finding_index_changes(spark, sf):
    docs = documents_of_connectors(spark, sf).where("id % 5 > 0")
    shot = lambda d, f: d.groupBy("connector_id").agg(F.count("*").alias("documents"), F.max("index_fingerprint").alias("f")).select("connector_id", "documents", F.expr(f).alias("fingerprint"))
    return findings.index_changes(
        shot(docs.where("connector_id % 6 > 0"), "f"), shot(docs.where("connector_id % 7 > 0 and (connector_id % 4 > 0 or id % 3 > 0)"), "case when connector_id % 5 = 1 then 'x' else f end")
    )


_LIMITS = "select id, gateway_id, case when id % 4 > 0 then end_user_id end as end_user_id, case when id % 2 = 0 then 100 end as gateway_rpm, 10 as user_rpm, 50 as gateway_concurrency, case when id % 3 = 0 then 2 end as user_concurrency from r"


def _limits(spark, sf):
    return requests(spark, sf).selectExpr(*_LIMITS.removeprefix("select ").removesuffix(" from r").split(", "))


_PLAN = f"""with {SQL_REQUESTS}, l as ({_LIMITS}), e as (select id, 0 as place, 'gateway' as scope, 'rpm' as "limit", gateway_rpm as value, 'rl:' || gateway_id || ':rpm' as key, 60 as window_seconds from l
  union all select id, 1, 'end_user', 'rpm', user_rpm, 'rl:' || gateway_id || ':' || end_user_id || ':rpm', 60 from l
  union all select id, 2, 'gateway', 'concurrency', gateway_concurrency, 'rl:' || gateway_id || ':concurrency', null from l
  union all select id, 3, 'end_user', 'concurrency', user_concurrency, 'rl:' || gateway_id || ':' || end_user_id || ':concurrency', null from l)"""


@query(f"{_PLAN} select * from e where value is not null and key is not null")
def limit_plan(spark, sf):
    return quotas.plan(_limits(spark, sf), ("rpm", "concurrency"))


@query(
    f"""{_PLAN}, x as (select *, greatest(0, value - id % 17) as remaining from e where value is not null and key is not null and window_seconds is not null)
select id, "limit", remaining, value, window_seconds from x qualify row_number() over (partition by id order by remaining / value, window_seconds, place) = 1"""
)
def limit_tightest(spark, sf):
    return quotas.tightest(quotas.plan(_limits(spark, sf), ("rpm", "concurrency")).withColumn("remaining", F.greatest(F.lit(0), F.col("value") - F.col("id") % 17)))


@query("select event_id, cast(case when event_id % 3 = 0 then 1 else greatest(1, ceil(value)) end as int) as retry_after from events")
def limit_retry_after(spark, sf):
    return table(spark, sf, "events").select("event_id", quotas.retry_after(F.col("event_id") % 3 == 0, F.col("value")).alias("retry_after"))


def rule_events(spark, sf):
    """Requests of three gateways under a rule of the gateway, one of the user and slots; settlements and releases between them."""
    rule = "named_struct('key', {0}, 'lease', {1}, 'value', {2}D, 'span', {3}, 'cost', {4})"
    rules = ", ".join((
        rule.format("concat('g', user_id % 3)", "false", 40, 86400, "double(1)"), rule.format("concat('u', user_id)", "false", 30, 86400, "double(event_id % 7)"),
        rule.format("concat('s', user_id % 3)", "true", 5, 20000, "double(1)"),
    ))
    rows = table(spark, sf, "events").selectExpr("event_id", "user_id % 3 as gateway_id", "unix_seconds(cast(ts as timestamp)) as at", "user_id", "event_type")
    asked = rows.selectExpr("event_id * 4 as event_id", "gateway_id", "at", "'consume' as kind", "string(event_id) as holder", f"array({rules}) as rules")
    settled = rows.where("event_id % 5 = 0").selectExpr("event_id * 4 + 1 as event_id", "gateway_id", "at + 10 as at", "'settle' as kind", "string(event_id) as holder", f"array({rule.format("concat('u', user_id)", "false", 30, 86400, "double(-3)")}) as rules")
    given = rows.where("event_id % 2 = 0").selectExpr("event_id * 4 + 2 as event_id", "gateway_id", "at + 900 as at", "'release' as kind", "string(event_id) as holder", f"array({rules}) as rules")
    return asked.unionByName(settled).unionByName(given)


@query(None)
def limiter_rules_replay(spark, sf):
    return quotas.replay(rule_events(spark, sf))


def memory_inputs(spark, sf):
    """Facts and candidates of users, with hashed texts as their vectors."""
    said = table(spark, sf, "events").selectExpr("event_id", "user_id as end_user_id", "value", "concat(event_type, ' ', user_id % 3, ' ', event_id % 11, ' ', event_id % 4) as text")
    vectors = embedding.embed(said.selectExpr("event_id as id", "text"), 64)
    rows = said.join(vectors, said["event_id"] == vectors["id"]).drop("id")
    facts = rows.where("event_id % 3 > 0").selectExpr("end_user_id", "event_id as fact_id", "embedding", "value / 100 as confidence", "event_id % 9 > 0 as live")
    new = rows.where("event_id % 3 = 0").selectExpr("end_user_id", "event_id as candidate_id", "event_id as place", "embedding", "value / 90 as confidence", "array(event_id - 1, event_id + 1, event_id - 100) as supersedes")
    return facts, new


@query(None)
def memory_reconciled(spark, sf):
    return reconciliation.reconcile(*memory_inputs(spark, sf), 0.95)


_REPLY = "case when event_id % 4 = 0 then 'no json' else concat(case when event_id % 4 = 1 then '```json\n' else '' end, '{\"facts\": [{\"text\": \" likes ', event_type, ' \", \"kind\": \"preference\", \"confidence\": ', case when event_id % 3 = 0 then '1.5' else '0.5' end, '}, {\"text\": \"\", \"confidence\": 0.1}, {\"text\": \"user ', user_id, '\", \"confidence\": 1}]}', case when event_id % 4 = 1 then '\n```' else '' end) end"


@query(
    """with e as (select event_id as id, unnest([{'i': 1, 't': case when event_id % 3 > 0 then 'likes ' || event_type end, 'k': 'preference', 'c': 0.5}, {'i': 2, 't': 'user ' || user_id, 'k': null, 'c': 1.0}], recursive := true) from events where event_id % 4 > 0)
select id, row_number() over (partition by id order by i) as place, t as text, k as kind, cast(c as double) as confidence from e where t is not null"""
)
def memory_parsed(spark, sf):
    replies = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.expr(_REPLY.replace("\n", "\\n")).alias("reply"))
    return reconciliation.parsed(replies)


@query("select user_id % 5 as gauge, min(value) as low from events where ts = (select max(ts) from events e2 where e2.user_id % 5 = events.user_id % 5) group by 1")
def metric_min_by_gauge(spark, sf):
    return metrics_ops.min_by_gauge(table(spark, sf, "events").select((F.col("user_id") % 5).alias("gauge"), "ts", "value"))
