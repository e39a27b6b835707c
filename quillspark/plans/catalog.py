"""Registered queries over the document catalog, connectors, users and settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import catalog
from quillspark.operators.lifecycle import FINAL
from quillspark.plans.registry import query
from quillspark.sources.tables import SQL_DOCUMENTS, documents_of_connectors, requests, table

D = f"with {SQL_DOCUMENTS}"
_FINAL = "status in ('indexed', 'failed', 'skipped')"


def _mime(kind: str) -> str:
    types = ", ".join(f"'{t}'" for t in catalog.KINDS[kind])
    return f"coalesce(mime_type in ({types}), false)"


_LABEL = "case " + " ".join(f"when {_mime(k)} then '{k}'" for k in catalog.KINDS) + " else 'other' end"


def _page(where: str, cols: str, limit: int, order: str) -> str:
    """DuckDB: a keyset page with its next cursor."""
    return f"""{D}, m as (select {cols} from d where {where} order by id {order} limit {limit + 1}), p as (select *, row_number() over (order by id {order}) as place, count(*) over () as n from m)
select * exclude (place, n), case when n > {limit} then max(case when place = {limit} then id end) over () end as next_cursor from p qualify place <= {limit}"""


@query(f"{D} select {_LABEL} as kind, count(*) as documents from d group by 1")
def catalog_formats(spark, sf):
    return documents_of_connectors(spark, sf).groupBy(catalog.format_label(F.col("mime_type")).alias("kind")).agg(F.count("*").alias("documents"))


@query(f"{D} select id, mime_type from d where {_LABEL} = 'other'")
def catalog_other_documents(spark, sf):
    return documents_of_connectors(spark, sf).where(catalog.of_kind("other")).select("id", "mime_type")


@query(f"{D} select id, mime_type from d where {_mime('csv')} or {_mime('code')}")
def catalog_scope_formats(spark, sf):
    return documents_of_connectors(spark, sf).where(catalog.in_scope("formats", ("csv", "code"))).select("id", "mime_type")


@query(f"{D} select id, reason from d where status = 'failed' and coalesce(reason, '') <> 'missing_object' and run_id = 1")
def catalog_scope_failed(spark, sf):
    return documents_of_connectors(spark, sf).where(catalog.in_scope("failed", run_id=1)).select("id", "reason")


@query(f"{D} select id from d where status = 'indexed' and index_fingerprint is null")
def catalog_scope_unrecorded(spark, sf):
    return documents_of_connectors(spark, sf).where(catalog.in_scope("unrecorded")).select("id")


@query(_page(f"connector_id = 3 and {_FINAL} and index_status = 'stale' and id > 500", "id, status, index_status", 20, "asc"))
def catalog_documents_in_scope(spark, sf):
    return catalog.documents_in_scope(documents_of_connectors(spark, sf).select("id", "status", "index_status", "connector_id"), 3, catalog.in_scope("stale"), 20, 500).drop("connector_id")


@query(_page("connector_id = 3 and status = 'indexed'", "id, status", 1000, "desc"))
def catalog_document_page(spark, sf):
    return catalog.document_page(documents_of_connectors(spark, sf), 3, 1000, status="indexed").select("id", "status", "next_cursor")


@query(f"{D} select id, status from d where run_id = 2 and not {_FINAL}")
def catalog_unfinished(spark, sf):
    return catalog.unfinished_for_run(documents_of_connectors(spark, sf), 2).select("id", "status")


@query(f"{D} select id, source_uri, etag, status from d where connector_id = 7")
def catalog_index(spark, sf):
    return catalog.index(documents_of_connectors(spark, sf), 7)


@query(f"{D} select id, source_uri, mime_type, size_bytes, status, index_fingerprint from d where connector_id = 7")
def catalog_audit_rows(spark, sf):
    return catalog.audit_rows(documents_of_connectors(spark, sf), 7)


_EXPECTED = {"text": "ch=1;em=m0;tk=w;sm=n;xv=1", "html": "ch=2;em=m1;tk=w;sm=n;xv=1", "other": "ch=0;em=m0;tk=w;sm=n;xv=1"}
_WANTED = f"case {_LABEL} " + " ".join(f"when '{k}' then case when index_fingerprint = '{v}' then 'current' else 'stale' end" for k, v in _EXPECTED.items()) + " end"


@query(
    f"""{D}, w as (select *, coalesce(status = 'indexed' and index_fingerprint is not null and index_status <> 'reprocessing' and index_status <> {_WANTED}, false) as changed, {_WANTED} as wanted from d)
select id, changed, case when changed then wanted else index_status end as index_status from w"""
)
def catalog_reconciled_status(spark, sf):
    return catalog.reconciled_status(documents_of_connectors(spark, sf), _EXPECTED).select("id", "changed", "index_status")


@query(f"{D} select id, case when index_fingerprint like 'ch=%' then regexp_replace(index_fingerprint, 'em=m[01]', 'em=' || substring(sha256('new'), 1, 12)) else index_fingerprint end as index_fingerprint from d")
def catalog_rewrite_embedding_model(spark, sf):
    return documents_of_connectors(spark, sf).select("id", catalog.with_embedding_model(F.col("index_fingerprint"), F.lit("new")).alias("index_fingerprint"))


def _connectors(spark, sf):
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("connector_id"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 2, "deleting").otherwise("ready").alias("status"), (400 + F.col("n_regionkey")).alias("chunking")
    )


@query(
    f"""{D}, c as (select connector_id, count(*) filter (index_status = 'stale') as stale, count(*) filter (index_status = 'reprocessing') as reprocessing from d group by 1)
select connector_id, n_name as name, stale, reprocessing from c join nation on n_nationkey = connector_id where stale > 0 or reprocessing > 0"""
)
def catalog_stale_connectors(spark, sf):
    return catalog.stale_connectors(documents_of_connectors(spark, sf), _connectors(spark, sf).select("connector_id", "name"))


@query(f"{D} select connector_id, status, count(*) as documents from d group by all")
def catalog_status_counts(spark, sf):
    return catalog.status_counts(documents_of_connectors(spark, sf))


@query(f"{D} select connector_id, {_LABEL} as kind, cast(count(*) as bigint) as documents from d where status = 'indexed' group by all")
def catalog_indexed_by_format(spark, sf):
    return catalog.indexed_by_format(documents_of_connectors(spark, sf))


@query(f"{D} select distinct connector_id, mime_type from d where index_status = 'stale'")
def catalog_stale_mime_types(spark, sf):
    return catalog.stale_mime_types(documents_of_connectors(spark, sf))


@query(f"{D} select organization_id, cast(sum(size_bytes) as bigint) as total_bytes from d group by 1")
def catalog_organization_bytes(spark, sf):
    return catalog.organization_bytes(documents_of_connectors(spark, sf))


@query(
    f"""{D}, c as (select connector_id, count(*) as n from d where status = 'indexed' group by 1)
select n_nationkey as connector_id, 400 + n_regionkey as chunking, coalesce(n, 0) as indexed_documents from nation left join c on n_nationkey = connector_id where n_regionkey <> 2"""
)
def catalog_connector_chunkings(spark, sf):
    return catalog.connector_chunkings(_connectors(spark, sf), documents_of_connectors(spark, sf))


@query(f"{D} select connector_id, cast(sum(case when chunks > 0 then chunks * 400 else floor(size_bytes / 4) end) as bigint) as tokens from d where {_FINAL} group by 1")
def catalog_estimate(spark, sf):
    rows = documents_of_connectors(spark, sf).where(F.col("status").isin(*FINAL))
    return rows.groupBy("connector_id").agg(F.sum(catalog.estimated_tokens(F.col("chunks"), F.lit(400), F.col("size_bytes"))).cast("bigint").alias("tokens"))


@query(
    """with m as (select event_id as id, event_type as action, user_id as actor_user_id from events where user_id % 2 = 1 and event_type = 'view' and ts >= timestamp '2024-01-03' and ts < timestamp '2024-01-28' and event_id < 900
  order by id desc limit 31), p as (select *, row_number() over (order by id desc) as place, count(*) over () as n from m)
select id, action, actor_user_id, case when n > 30 then max(case when place = 30 then id end) over () end as next_cursor from p qualify place <= 30"""
)
def catalog_audit_events(spark, sf):
    events = table(spark, sf, "events").selectExpr("event_id as id", "ts as created_at", "event_type as action", "user_id as actor_user_id", "user_id % 2 as organization_id")
    return catalog.audit_events(events, 30, 900, "2024-01-03", "2024-01-28", organization_id=1, action="view", target_id=None).select("id", "action", "actor_user_id", "next_cursor")


@query(
    """with m as (select c_custkey as id, c_name || '_' || c_mktsegment as external_id from customer where lower(c_name || '_' || c_mktsegment) like '%1\\_build%' escape '\\' order by id desc limit 11),
p as (select *, row_number() over (order by id desc) as place, count(*) over () as n from m)
select id, external_id, case when n > 10 then max(case when place = 10 then id end) over () end as next_cursor from p qualify place <= 10"""
)
def catalog_users_page(spark, sf):
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws("_", "c_name", "c_mktsegment").alias("external_id"))
    return catalog.users_page(users, 10, search="1_BUILD")


@query("select c_custkey as id, coalesce(n, 0) as facts from customer left join (select user_id, count(*) as n from events where event_type = 'view' group by 1) on user_id = c_custkey where c_custkey < 200")
def catalog_users_with_facts(spark, sf):
    counts = table(spark, sf, "events").where("event_type = 'view'").groupBy(F.col("user_id").alias("end_user_id")).agg(F.count("*").alias("facts"))
    return catalog.users_with_facts(table(spark, sf, "customer").where("c_custkey < 200").select(F.col("c_custkey").alias("id")), counts)


@query("select distinct l_orderkey as gateway_id from lineitem where l_partkey = 5")
def catalog_referencing(spark, sf):
    return catalog.referencing(table(spark, sf, "lineitem").selectExpr("l_orderkey as gateway_id", "l_partkey as model_id"), 5)


@query("select cast(s_suppkey as varchar) as key, s_acctbal as value, c_name as editor from supplier left join customer on c_custkey = s_nationkey")
def catalog_settings(spark, sf):
    settings = table(spark, sf, "supplier").selectExpr("cast(s_suppkey as string) as key", "s_acctbal as value", "s_nationkey as updated_by")
    return catalog.settings_with_editor(settings, table(spark, sf, "customer").selectExpr("c_custkey as id", "c_name as name"))


@query("select count(*) as removed from orders where o_custkey % 4 = 2")
def catalog_purge(spark, sf):
    return catalog.purge(documents_of_connectors(spark, sf), 2)[1]


@query("select gateway_id, count(*) as keys from (select user_id % 3 as gateway_id from events where event_type <> 'signup') where gateway_id in (0, 2) group by 1")
def catalog_key_counts(spark, sf):
    return requests(spark, sf).where("latency_retrieval_ms is not null and gateway_id in (0, 2)").groupBy("gateway_id").agg(F.count("*").alias("keys"))
