"""Registered queries of the vector audit and of snapshot differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import embedding
from quillspark.operators import retrieval, snapshots, vector_audit
from quillspark.plans.registry import query
from quillspark.sources.tables import table

_NORM = "sqrt(list_sum(list_transform(e, lambda x: cast(x as double) * cast(x as double))))"
_POINTS = """p as (select vec_id as id, label as document_id, case when vec_id % 50 = 7 then list_transform(embedding, lambda x: x * 0) when vec_id % 50 = 8 then embedding[1:60] when vec_id % 50 = 9 then list_transform(embedding, lambda x: x * 2)
  when vec_id % 50 = 11 then list_transform(embedding, lambda x: cast(1 as float)) else embedding end as e, vec_id % 50 = 11 as copy_ from embeddings)"""


def _points(spark, sf):
    e = "case when vec_id % 50 = 7 then transform(embedding, x -> x * 0) when vec_id % 50 = 8 then slice(embedding, 1, 60) when vec_id % 50 = 9 then transform(embedding, x -> x * 2) when vec_id % 50 = 11 then transform(embedding, x -> 1.0F) else embedding end"
    return table(spark, sf, "embeddings").selectExpr("vec_id as id", "bigint(label) as document_id", f"{e} as embedding", "sha2(string(vec_id), 256) as text_hash", "concat('text ', vec_id) as text")


@query(
    f"""with {_POINTS}, n as (select *, {_NORM} as n from p), s as (select count(*) as scanned from n),
q as (select id, document_id, e, n from n where id % 50 = 3),
k as (select q.id, q.document_id as own, o.document_id as other, round(coalesce(list_dot_product(q.e, o.e) / nullif(q.n * o.n, 0), 0), 6) as score, o.id as oid from q join n o on o.id <> q.id and len(o.e) = len(q.e)),
b as (select * from k qualify row_number() over (partition by id order by score desc, oid) = 1),
f as (
  select 'dimension_mismatch' as code, 'red' as severity, count(*) as count, count(distinct document_id) as documents from n where len(e) <> 64
  union all select 'zero_vectors', case when count(*) >= 0.01 * any_value(scanned) then 'red' else 'amber' end, count(*), count(distinct document_id) from n, s where n < 1e-6
  union all select 'identical_vectors', case when count(*) >= 0.05 * any_value(scanned) then 'red' else 'amber' end, count(*), count(distinct document_id) from n, s where copy_
  union all select 'norm_spread', 'amber', count(*), null from n where n >= 1e-6
  union all select 'model_mismatch', 'amber', count(*), count(*) from customer where c_custkey % 5 = 1
  union all select 'low_agreement', case when avg(score) filter (own <> other) >= 0.9 then 'amber' else 'red' end, case when count(*) filter (own = other) < 0.7 * count(*) then count(*) filter (own <> other) else 0 end, null from b
  union all select 'near_duplicate_vectors', 'amber', count(*), count(distinct own) from b where own <> other and score >= 0.98)
select * from f where count > 0"""
)
def vector_audit_findings(spark, sf):
    """All findings over vectors of which some are zero, short, long or copies, with a stated set of neighbours."""
    points = _points(spark, sf)
    # A query of another width than a point's is like no such point; here all asked ones have 64 components.
    asked = points.where("id % 50 = 3").selectExpr("id as query_id", "embedding as query")
    near = retrieval.knn(points.where("size(embedding) = 64"), asked, 1, exclude_self=True)
    documents = table(spark, sf, "customer").selectExpr("c_custkey as document_id", "case when c_custkey % 5 = 0 then null when c_custkey % 5 = 1 then 'old' else 'new' end as embedding_model")
    return vector_audit.findings(points, 64, "new", documents, near)


@query(None)
def vector_audit_drift(spark, sf):
    """Findings whose drift comes from a sample of 60 documents, embedded anew: every other one by a model that reads other words."""
    docs = table(spark, sf, "documents").selectExpr("doc_id as id", "doc_id as document_id", "sha2(coalesce(text, ''), 256) as text_hash", "coalesce(text, '') as text")
    held = docs.join(embedding.embed(docs.select("id", "text"), 32), "id")
    turned = lambda t: embedding.embed(t.withColumn("text", F.expr("case when id % 2 = 0 then regexp_replace(text, '([a-zA-Z]+)', '$1q') else text end")), 32)
    samples = vector_audit.drift_samples(held, turned, 60, "hash-32")
    return vector_audit.findings(held, 32, "hash-32", docs.selectExpr("id as document_id", "'hash-32' as embedding_model"), None, samples)


@query(
    """with c as (select c_custkey as id, c_name, c_acctbal, c_mktsegment, c_custkey % 7 as k from customer),
r as (
  select id, 'limits.daily' as path, 'changed' as change, cast(k as varchar) as b, cast(k + 1 as varchar) as a from c where k < 3
  union all select id, 'limits.deep.on', 'changed', 'false', '0' from c where k = 4
  union all select id, 'limits.deep.list', 'changed', '[1,' || k || ']', '[1,' || k || ',null]' from c where k = 5
  union all select id, 'key', 'changed', '"[redacted]"', '"[redacted]"' from c where k = 2
  union all select id, 'name', 'removed', to_json(c_name)::varchar, null from c where k = 6
  union all select id, 'segment', 'added', null, to_json(c_mktsegment)::varchar from c where k = 1
  union all select id, 'gone', 'added', null, 'null' from c where k = 3)
select id, cast(row_number() over (partition by id order by path) as integer) as place, path, change, b as before, a as after, false as truncated, 0 as omitted from r"""
)
def snapshot_changes(spark, sf):
    """Fields that changed between two nested settings of each customer."""
    c = table(spark, sf, "customer").selectExpr("c_custkey as id", "c_name", "c_mktsegment", "c_custkey % 7 as k")
    name, segment = "substring(to_json(array(c_name)), 2, length(to_json(array(c_name))) - 2)", "substring(to_json(array(c_mktsegment)), 2, length(to_json(array(c_mktsegment))) - 2)"
    before = c.selectExpr("id", f"concat('{{\"name\": ', {name}, ', \"key\": \"k', id, '\", \"limits\": {{\"daily\": ', k, ', \"deep\": {{\"on\": false, \"list\": [1, ', k, '], \"empty\": {{}}}}}}}}') as body")
    after = c.selectExpr(
        "id",
        f"concat('{{\"limits\": {{\"deep\": {{\"list\": [1, ', k, case when k = 5 then ', null' else '' end, '], \"on\": ', case when k = 4 then '0' else 'false' end, '}}, \"daily\": ', case when k < 3 then k + 1 else k end, '}}', case when k = 6 then '' else concat(', \"name\": ', {name}) end,"
        f" case when k = 1 then concat(', \"segment\": ', {segment}) else '' end, case when k = 3 then ', \"gone\": null' else '' end, ', \"key\": \"', case when k = 2 then 'new' else 'k' end, id, '\"}}') as body",
    )
    return snapshots.diff(before, after, sensitive=("key",))
