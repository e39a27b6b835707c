"""Registered queries over routing, audits' alerts, encodings and chunking previews."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import preview, routing
from quillspark.plans.registry import query
from quillspark.sources.tables import table


@query("select conv_id, cast(sum(coalesce(len(regexp_extract_all(text, '[\\w\\p{L}\\p{M}\\p{N}]+|[^\\w\\p{L}\\p{M}\\p{N}\\s]')), 0)) as bigint) as tokens from conversations group by conv_id")
def prompt_token_sums(spark, sf):
    return routing.prompt_tokens(table(spark, sf, "conversations").select("conv_id", F.col("text").alias("content")), "conv_id")


@query(
    """with g as (select * from (values (0, 'failover'), (1, 'single'), (2, 'later')) g(gateway_id, mode)), t as (select * from (values (0, 'b', 2), (0, 'a', 1), (0, 'c', 3), (1, 'd', 5), (1, 'e', 4), (2, 'f', 1), (2, 'g', 1)) t(gateway_id, target, priority)),
r as (select *, row_number() over (partition by gateway_id order by priority, target) as place from t)
select event_id as id, cast(place as integer) as place, target, mode = 'failover' as can_retry from events join g on user_id % 4 = g.gateway_id join r on r.gateway_id = g.gateway_id where mode = 'failover' or place = 1"""
)
def route_attempts(spark, sf):
    """Attempts of every request by its gateway's mode; requests of a gateway without targets have none."""
    requests = table(spark, sf, "events").selectExpr("event_id as id", "user_id % 4 as gateway_id", "user_id as end_user_id")
    gateways = spark.createDataFrame([(0, "failover"), (1, "single"), (2, "later"), (3, "failover")], "gateway_id bigint, mode string")
    targets = spark.createDataFrame([(0, "b", 2, 1), (0, "a", 1, 1), (0, "c", 3, 1), (1, "d", 5, 1), (1, "e", 4, 1), (2, "f", 1, 1), (2, "g", 1, 1)], "gateway_id bigint, target string, priority int, weight int")
    return routing.attempts(requests, gateways, targets)


@query(
    """with a as (select o_orderkey as audit_id, o_custkey as connector_id, o_orderpriority as kind, o_orderdate as created_at, case when o_orderstatus = 'F' then 'succeeded' else 'failed' end as status, case when o_orderkey % 3 = 0 then 'red' else 'amber' end as severity from orders)
select connector_id, c_name as name, kind, audit_id from (select * from a qualify row_number() over (partition by connector_id, kind order by created_at desc, audit_id desc) = 1) join customer on c_custkey = connector_id
where status = 'succeeded' and severity = 'red' and c_custkey % 7 > 0"""
)
def audit_red_alerts(spark, sf):
    audits = table(spark, sf, "orders").selectExpr("o_orderkey as audit_id", "o_custkey as connector_id", "o_orderpriority as kind", "o_orderdate as created_at", "case when o_orderstatus = 'F' then 'succeeded' else 'failed' end as status", "case when o_orderkey % 3 = 0 then 'red' else 'amber' end as severity")
    return routing.audit_alerts(audits, table(spark, sf, "customer").where("c_custkey % 7 > 0").selectExpr("c_custkey as connector_id", "c_name as name"))


@query("select doc_id, case when doc_id % 5 = 4 then null else sha256(coalesce(text, '')) end as text_sha256 from documents")
def bytes_decoded(spark, sf):
    """Texts of all documents back from bytes in four encodings; every fifth one is cut within a character and stays unread."""
    t = "coalesce(text, '')"
    raw = f"case doc_id % 5 when 0 then encode({t}, 'UTF-8') when 1 then concat(unhex('EFBBBF'), encode({t}, 'UTF-8')) when 2 then concat(unhex('FFFE'), encode({t}, 'UTF-16LE')) when 3 then concat(unhex('FEFF'), encode({t}, 'UTF-16BE')) else concat(encode({t}, 'UTF-8'), unhex('C3')) end"
    docs = table(spark, sf, "documents").selectExpr("doc_id", f"{raw} as data")
    return docs.select("doc_id", F.sha2(routing.decoded(F.col("data")), 256).alias("text_sha256"))


CANDIDATES = (preview.Candidate("small", 100, 10), preview.Candidate("fixed", 250, 0, False), preview.Candidate("large", 600, 60))


@query(None)
def chunking_preview(spark, sf):
    """Three configurations over all documents side by side."""
    return preview.compared(preview.chunks(table(spark, sf, "documents"), CANDIDATES), CANDIDATES)
