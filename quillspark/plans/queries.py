"""Registered queries over the driver's tables, each with its SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import strings
from quillspark.operators import evaluation, ledgers, lifecycle, memory, metrics, retrieval, text
from quillspark.plans.registry import SQL, query
from quillspark.sources.tables import SQL_REQUESTS, requests, scoped, table
from quillspark.streaming import limits

WINDOW = metrics.Filters("2024-01-05", "2024-01-20")
IN = WINDOW.sql()
NOW = "2024-02-01 00:00:00"
R = f"with {SQL_REQUESTS}"


def _pct(col: str, prefix: str) -> str:
    return ", ".join(f"cast(quantile_disc({col}, {p}) as int) as {prefix}_{n}" for n, p in metrics.P)


_SUMMARY = f"""select *, coalesce(errors / nullif(requests, 0), 0.0) as error_rate,
  coalesce(retrieval_empty / nullif(retrieval_attempts, 0), 0.0) as empty_retrieval_rate, coalesce(uncited_requests / nullif(injected_requests, 0), 0.0) as uncited_rate
from (select count(*) as requests, count(*) filter (status_code >= 400) as errors,
  {_pct("latency_total_ms", "total")}, {_pct("latency_ttft_ms", "ttft")}, {_pct("latency_retrieval_ms", "retrieval")},
  cast(coalesce(sum(prompt_tokens), 0) as bigint) as prompt_tokens, cast(coalesce(sum(completion_tokens), 0) as bigint) as completion_tokens,
  count(latency_retrieval_ms) as retrieval_attempts, count(*) filter (latency_retrieval_ms is not null and n_retrieved = 0) as retrieval_empty,
  count(*) filter (status_code < 400 and coalesce(n_retrieved, 0) > 0) as injected_requests,
  count(*) filter (status_code < 400 and coalesce(n_retrieved, 0) > 0 and n_cited = 0) as uncited_requests
from r where """


@query(f"{R} {_SUMMARY} {IN})")
def metrics_summary(spark, sf):
    return metrics.summary(requests(spark, sf), WINDOW)


_NARROW = metrics.Filters("2024-01-03", "2024-01-25", gateway_id=1, status_class="2xx", min_latency_ms=100, uncited=True)


@query(f"{R} {_SUMMARY} {_NARROW.sql()})")
def metrics_summary_filtered(spark, sf):
    return metrics.summary(requests(spark, sf), _NARROW)


_TALK = metrics.Filters("2024-01-03", "2024-01-25", session="s1", search="5 SAID no")


@query(f"{R} {_SUMMARY} {_TALK.sql()})")
def metrics_summary_of_session(spark, sf):
    return metrics.summary(requests(spark, sf), _TALK)


@query(f"{R} {_SUMMARY} organization_id = 1 and {IN})")
def metrics_summary_of_organization(spark, sf):
    return metrics.summary(scoped(requests(spark, sf), 1), WINDOW)


@query(f"{R} {_SUMMARY} created_at < timestamp '1999-01-01')")
def metrics_summary_of_empty_window(spark, sf):
    return metrics.summary(requests(spark, sf), metrics.Filters("1998-01-01", "1998-02-01"))


def _series_sql(seconds: int, group: str, named: dict[str, str]) -> str:
    parts = " union all ".join(
        f"select bucket, grouping, '{n}' as series, v{i} as value from g where v{i} is not null" for i, n in enumerate(named)
    )
    cols = ", ".join(f"cast({e} as double) as v{i}" for i, e in enumerate(named.values()))
    return f"{R}, g as (select time_bucket(interval {seconds} seconds, created_at) as bucket, {group} as grouping, {cols} from r where {IN} group by all) {parts}"


_CLASS = "cast(status_code // 100 as varchar) || 'xx'"


@query(_series_sql(21600, "cast(null as varchar)", {n: f"quantile_disc(latency_total_ms, {p})" for n, p in metrics.P}))
def metrics_timeseries_latency(spark, sf):
    return metrics.timeseries(requests(spark, sf), WINDOW, "latency", 21600)


@query(_series_sql(metrics.choose_interval(15 * 86400), _CLASS, {"requests": "count(*)", "errors": "count(*) filter (status_code >= 400)"}))
def metrics_timeseries_requests(spark, sf):
    return metrics.timeseries(requests(spark, sf), WINDOW, "requests", metrics.choose_interval(15 * 86400), "status")


@query(_series_sql(86400, "coalesce(model_name, '(unknown)')", {"prompt": "coalesce(sum(prompt_tokens), 0)", "completion": "coalesce(sum(completion_tokens), 0)"}))
def metrics_timeseries_tokens(spark, sf):
    return metrics.timeseries(requests(spark, sf), WINDOW, "tokens", 86400, "model")


@query(_series_sql(3600, "cast(gateway_id as varchar)", {
    "attempts": "count(latency_retrieval_ms)",
    "empty_rate": "count(*) filter (latency_retrieval_ms is not null and n_retrieved = 0) / nullif(count(latency_retrieval_ms), 0)",
}))
def metrics_timeseries_retrieval(spark, sf):
    return metrics.timeseries(requests(spark, sf), WINDOW, "retrieval", 3600, "gateway")


@query(
    f"""with l as ({SQL["metrics_timeseries_tokens"]}) select bucket, string_agg(coalesce("grouping" || '.', '') || series, ',' order by coalesce("grouping" || '.', '') || series) as names, round(sum(value), 6) as total from l group by 1"""
)
def metrics_timeseries_wide(spark, sf):
    rows = metrics.wide(metrics_timeseries_tokens(spark, sf))
    total = F.aggregate(F.map_values("values"), F.lit(0.0), lambda a, v: a + v)
    return rows.select("bucket", F.array_join(F.array_sort(F.map_keys("values")), ",").alias("names"), F.round(total, 6).alias("total"))


@query(f"{R} select {_CLASS} as status_class, coalesce(error_code, '') as error_code, coalesce(model_name, '(unknown)') as model_name, count(*) as requests from r where {IN} group by all")
def metrics_taxonomy(spark, sf):
    return metrics.taxonomy(requests(spark, sf), WINDOW)


@query(
    f"{R} select end_user_id, throttled, c_name as name from (select end_user_id, count(*) as throttled from r where {IN} and error_code = 'rate_limited' group by 1)"
    " join customer on c_custkey = end_user_id order by throttled desc, end_user_id limit 10"
)
def metrics_throttled(spark, sf):
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("end_user_id"), F.col("c_name").alias("name"))
    return metrics.throttled_end_users(requests(spark, sf), users, WINDOW)


@query(f"{R} select template, min(created_at) as first_seen, count(*) as requests from r where {IN} group by 1")
def metrics_templates(spark, sf):
    return metrics.template_fingerprints(requests(spark, sf), WINDOW)


@query(
    f"""{R}, s as (select model_name, tokenizer, cast(sum(estimated_prompt_tokens) as bigint) as estimated, cast(sum(prompt_tokens) as bigint) as reported, count(*) as samples
from r where {IN} and status_code < 400 and prompt_tokens is not null and estimated_prompt_tokens is not null and model_name is not null and tokenizer is not null group by 1, 2)
select *, round(reported / estimated, 6) as ratio, abs(reported / estimated - 1) > 0.15 as drifts, round(greatest(1.0, least(20.0, 4.0 / (reported / estimated))), 3) as proposed from s"""
)
def metrics_calibration(spark, sf):
    return metrics.calibration(requests(spark, sf), WINDOW)


_PAGE = metrics.Filters("2024-01-01", "2024-02-01", search="RATE", streamed=True)


@query(f"{R} select id, created_at, end_user_id, status_code, latency_total_ms from r where {_PAGE.sql()} and id < 900 order by id desc limit 50")
def metrics_logs_page(spark, sf):
    return metrics.logs(requests(spark, sf), _PAGE, after=900).select("id", "created_at", "end_user_id", "status_code", "latency_total_ms")


@query(
    f"""{R} select id, model_name, round(sum(prompt_tokens) over w / sum(estimated_prompt_tokens) over w, 6) as ratio from r
where prompt_tokens is not null and estimated_prompt_tokens is not null and model_name is not null
window w as (partition by model_name order by created_at, id rows between 255 preceding and current row)"""
)
def metrics_drift_window(spark, sf):
    return metrics.drift_window(requests(spark, sf))


@query(f"{R} select time_bucket(interval 300 seconds, created_at) as bucket, model_name as key, count(*) / 300 as per_second from r group by all")
def metric_rate(spark, sf):
    return metrics.rate(requests(spark, sf), "model_name")


_RATIO = "select time_bucket(interval 3600 seconds, created_at) as bucket, count(*) filter (status_code >= 500) / greatest(count(*), 0.001) as ratio from r group by all"


@query(f"{R} {_RATIO}")
def metric_error_ratio(spark, sf):
    return metrics.error_ratio(requests(spark, sf))


@query(
    f"""{R}, h as (select gateway_id, count(latency_total_ms) as n, {", ".join(f"count(*) filter (latency_total_ms <= {b}) as b{b}" for b in metrics.BOUNDS)} from r group by 1)
select gateway_id, round(case {" ".join(f"when b{b} >= 0.9 * n then {lo} + {b - lo} * (0.9 * n - {f'b{lo}' if lo else 0}) / (b{b} - {f'b{lo}' if lo else 0})" for lo, b in zip((0, *metrics.BOUNDS), metrics.BOUNDS, strict=False))} else {metrics.BOUNDS[-1]} end, 6) as quantile from h"""
)
def metric_histogram_quantile(spark, sf):
    return metrics.histogram_quantile(requests(spark, sf), 0.9)


@query(
    f"""{R}, h as (select gateway_id, time_bucket(interval 1 hour, created_at) as bucket, min(latency_total_ms) as low from r group by all)
select gateway_id, bucket, min(low) over (partition by gateway_id order by bucket range between interval 1 day preceding and current row) as min_over_time from h"""
)
def metric_min_over_time(spark, sf):
    return metrics.min_over_time(requests(spark, sf))


@query(
    f"""{R}, q as ({_RATIO}), h as (select bucket, cast(epoch(bucket) // 3600 as bigint) as n from q where ratio > 0.1), i as (select *, n - row_number() over (order by n) as island from h)
select min(bucket) as since, max(bucket) as until, count(*) as buckets from i group by island having count(*) >= 2"""
)
def metric_alerts(spark, sf):
    return metrics.alerts(metrics.error_ratio(requests(spark, sf)), 0.1, 3600, 2)


def _runs(spark, sf):
    return table(spark, sf, "orders").select(
        F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("outcome"), F.col("o_custkey").alias("end_user_id"), F.col("o_totalprice").alias("spend")
    )


@query(
    """select cast(o_orderdate as date) as day, count(*) as runs, count(*) filter (o_orderstatus = 'F') as finished, count(*) filter (o_orderstatus = 'P') as failed,
  count(distinct o_custkey) as people, round(sum(o_totalprice), 2) as spend, round(count(*) filter (o_orderstatus = 'P') / count(*), 6) as failure_rate
from orders group by rollup (1)"""
)
def ledger_health(spark, sf):
    return ledgers.health(_runs(spark, sf))


@query(
    """select end_user_id, runs, spend, c_name as name from (select o_custkey as end_user_id, count(*) as runs, round(sum(o_totalprice), 2) as spend from orders group by 1 order by 3 desc, 1 limit 10)
left join (select * from customer where c_custkey % 2 = 0) on c_custkey = end_user_id"""
)
def ledger_spend(spark, sf):
    names = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("end_user_id"), F.col("c_name").alias("name"))
    return ledgers.spend_by(_runs(spark, sf), names, "end_user_id")


@query("select distinct on (o_custkey, o_orderstatus) o_custkey, o_orderstatus, o_orderdate, o_orderkey from orders order by o_custkey, o_orderstatus, o_orderdate desc, o_orderkey desc")
def ledger_latest(spark, sf):
    return ledgers.latest(table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey"), ["o_custkey", "o_orderstatus"], "o_orderdate", "o_orderkey")


_INDEX = {
    "connector_id": "o_custkey % 20",
    "status": "case when o_orderkey % 10 = 0 then 'parsing' else 'indexed' end",
    "fingerprint": "case when o_orderkey % 7 = 0 then null else concat('fp', cast(o_orderkey % 3 as string)) end",
    "index_status": "case when o_orderkey % 4 = 0 then 'stale' else 'current' end",
    "updated_at": "o_orderdate",
}


def _index(spark, sf):
    return table(spark, sf, "orders").select(*(F.expr(e).alias(c) for c, e in _INDEX.items()))


_SQL_INDEX = "with d as (select " + ", ".join(f"{e.replace('as string', 'as varchar')} as {c}" for c, e in _INDEX.items()) + " from orders)"


@query(
    f"""{_SQL_INDEX}, s as (select connector_id, case when status = 'indexed' and fingerprint is null then 'unrecorded' else index_status end as s from d)
select connector_id, count(*) filter (s = 'current') as current, count(*) filter (s = 'stale') as stale, count(*) filter (s = 'unrecorded') as unrecorded from s group by 1"""
)
def index_status_counts(spark, sf):
    return ledgers.status_counts(_index(spark, sf))


@query(f"{_SQL_INDEX} select n_nationkey as connector_id, n_name as name, count(*) as stale, min(updated_at) as oldest from d join nation on n_nationkey = connector_id where index_status = 'stale' group by all")
def index_stale_summaries(spark, sf):
    connectors = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("connector_id"), F.col("n_name").alias("name"))
    return ledgers.stale_summaries(connectors, _index(spark, sf))


@query("select source, count(*) as documents, cast(coalesce(sum(n_chars), 0) as bigint) as total_bytes from documents group by 1")
def document_totals(spark, sf):
    return ledgers.totals(table(spark, sf, "documents").withColumn("size_bytes", F.col("n_chars")), "source")


@query(
    f"""{R}, u as (select gateway_id, 'l' || (id % 5) as limit_name, round(count(*) / 1000, 6) as utilisation from r group by all)
select gateway_id, max(utilisation) as utilisation, arg_max(limit_name, (utilisation, limit_name)) as limit_name from u group by 1 having max(utilisation) >= 0.05"""
)
def limit_pressure(spark, sf):
    use = requests(spark, sf).groupBy("gateway_id", F.concat(F.lit("l"), (F.col("id") % 5).cast("string")).alias("limit_name"))
    return ledgers.pressure(use.agg(F.round(F.count("*") / 1000, 6).alias("utilisation")), 0.05)


@query(
    """select c_custkey as id, case when c_custkey % 3 = 0 then null else c_custkey % 50 end as rpm, least(case when c_custkey % 4 = 0 then null else c_custkey % 90 end, 40) as tpm,
  array_to_string(list_filter([case when c_custkey % 4 = 0 or c_custkey % 90 > 40 then 'tpm' end], lambda x: x is not null), ',') as capped from customer"""
)
def limit_ceilings(spark, sf):
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.expr("case when c_custkey % 3 = 0 then null else c_custkey % 50 end").alias("rpm"),
        F.expr("case when c_custkey % 4 = 0 then null else c_custkey % 90 end").alias("tpm"), F.lit(None).cast("bigint").alias("rpm_ceiling"), F.lit(40).cast("bigint").alias("tpm_ceiling"),
    )
    return ledgers.ceilings(rows, ("rpm", "tpm"))


_ETAG = "case when o_orderkey % 5 > 0 then o_orderkey % 5 end"
_STATUS = "case when o_orderkey % 17 = 0 then 'parsing' when o_orderkey % 17 = 1 then 'skipped' when o_orderkey % 17 > 2 then 'indexed' end"
_NEW = f"select o_orderkey as key, {_ETAG} as etag from orders where o_orderkey % 11 <> 0"
_OLD = f"select o_orderkey as key, case when o_orderkey % 13 = 0 then -1 else {_ETAG} end as etag, {_STATUS} as status from orders where o_orderkey % 7 <> 0"


@query(
    f"""select coalesce(a.key, b.key) as key, case when b.key is null then 'added' when a.key is null then case when b.status in ('indexed', 'failed', 'skipped') then 'deleted' else 'kept' end
  when coalesce(b.status not in ('indexed', 'failed', 'skipped'), true) then 'skipped'
  when a.etag is not distinct from b.etag then 'unchanged' else 'updated' end as action from ({_NEW}) a full join ({_OLD}) b on a.key = b.key"""
)
def lifecycle_reconcile(spark, sf):
    rows = table(spark, sf, "orders")
    listing = rows.where("o_orderkey % 11 <> 0").selectExpr("o_orderkey as key", f"{_ETAG} as etag")
    known = rows.where("o_orderkey % 7 <> 0").selectExpr("o_orderkey as key", f"case when o_orderkey % 13 = 0 then -1 else {_ETAG} end as etag", f"{_STATUS} as status")
    return lifecycle.reconcile(listing, known)


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P')")
def lifecycle_orphans(spark, sf):
    owners = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return lifecycle.orphans(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), owners, "l_orderkey")


def _days(spark, sf):
    return table(spark, sf, "events").select(F.to_date("ts").alias("day")).distinct()


_DAYS = "(select distinct cast(ts as date) as day from events)"


@query(f"select day, case when day < date '2024-01-30' - 20 then 'drop' when day < date '2024-01-30' - 7 then 'strip' else 'keep' end as action from {_DAYS}")
def lifecycle_retention(spark, sf):
    return lifecycle.retention(_days(spark, sf), "2024-01-30", 20, 7)


@query(
    f"""select day, case when day < date '2024-01-05' then 'keep' when day < date '2024-01-30' - 20 then 'drop' when day < date '2024-01-30' - 7 then 'strip' else 'keep' end as action from {_DAYS}"""
)
def lifecycle_retention_from(spark, sf):
    return lifecycle.retention(_days(spark, sf), "2024-01-30", 20, 7, floor="2024-01-05")


@query(
    f"""select 'create' as action, day from (select cast(unnest(generate_series(date '2024-01-15', date '2024-02-10', interval 1 day)) as date) as day) where day not in (select day from {_DAYS})
union all select 'drop', day from {_DAYS} where day < date '2024-01-25' - 12"""
)
def lifecycle_partition_plan(spark, sf):
    return lifecycle.partition_plan(_days(spark, sf), "2024-01-25", 16, 10, 12)


@query(f"select day from (select cast(unnest(generate_series(date '2024-01-15', date '2024-02-10', interval 1 day)) as date) as day) where day not in (select day from {_DAYS})")
def lifecycle_missing_days(spark, sf):
    return lifecycle.missing_days(_days(spark, sf), "2024-01-25", 16, 10)


@query(f"select count(*) as days_ahead from (select date_diff('day', date '2024-01-12', day) - row_number() over (order by day) + 1 as gap from {_DAYS} where day >= date '2024-01-12') where gap = 0")
def lifecycle_runway(spark, sf):
    return lifecycle.runway(_days(spark, sf), "2024-01-12")


def _fp(size, model) -> Column:
    return lifecycle.fingerprint(size, model, F.lit("words"), F.lit("none"), F.lit(1))


def _duck_fp(size: str, model: str) -> str:
    return " || ';' || ".join(f"'{n}=' || substring(sha256(cast({e} as varchar)), 1, 12)" for n, e in (("ch", size), ("em", model), ("tk", "'words'"), ("sm", "'none'"), ("xv", "1")))


@query(
    f"""select p_partkey, case when p_partkey % 5 = 0 then 'unrecorded' when p_partkey % 3 = 1 then 'embedding_model' when p_partkey % 2 = 1 then 'chunking' end as reason,
  {_duck_fp("400", "'e0'")} as expected from part"""
)
def lifecycle_stale_reasons(spark, sf):
    recorded = F.when(F.col("p_partkey") % 5 != 0, _fp(F.when(F.col("p_partkey") % 2 == 1, 300).otherwise(400), F.when(F.col("p_partkey") % 3 == 1, F.lit("e1")).otherwise(F.lit("e0"))))
    expected = _fp(F.lit(400), F.lit("e0"))
    return table(spark, sf, "part").select("p_partkey", lifecycle.stale_reason(recorded, expected).alias("reason"), expected.alias("expected"))


@query(
    """select coalesce(s.s_suppkey, n.k) as s_suppkey, coalesce(n.name, s_name) as s_name, coalesce(n.bal, s_acctbal) as s_acctbal from supplier s
full join (select c_custkey as k, c_name as name, case when c_custkey % 2 = 0 then c_acctbal end as bal from customer where c_custkey % 3 = 0) n on n.k = s.s_suppkey"""
)
def lifecycle_upsert(spark, sf):
    changes = table(spark, sf, "customer").where("c_custkey % 3 = 0").selectExpr("c_custkey as s_suppkey", "c_name as s_name", "case when c_custkey % 2 = 0 then c_acctbal end as s_acctbal")
    return lifecycle.upsert(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal"), changes, "s_suppkey")


@query(
    """select c_custkey as end_user_id, 5 + coalesce(n, 0) as requests, greatest(timestamp '2024-01-10', coalesce(seen, timestamp '2024-01-10')) as last_seen
from customer left join (select user_id, count(*) as n, max(ts) as seen from events group by 1) on user_id = c_custkey"""
)
def lifecycle_bump(spark, sf):
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("end_user_id"), F.lit(5).cast("bigint").alias("requests"), F.lit("2024-01-10").cast("timestamp_ntz").alias("last_seen"))
    return lifecycle.bump(users, table(spark, sf, "events").select(F.col("user_id").alias("end_user_id"), F.col("ts").alias("created_at")))


@query("select e.event_id, e.user_id from events e where user_id not in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def lifecycle_erase(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("user_id").alias("end_user_id"))
    gone = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("end_user_id"))
    return lifecycle.erase(rows, gone).withColumnRenamed("end_user_id", "user_id")


def _points(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("document_id"))


def _asked(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


_COS = "round(list_cosine_similarity(q.embedding::double[], p.embedding::double[]), 6)"
_KNN = f"select q.vec_id as query_id, p.vec_id as id, {_COS} as score from embeddings q join embeddings p on q.vec_id % 50 = 0"


@query(f"select query_id, id, row_number() over (partition by query_id order by score desc, id) as rank, score from ({_KNN}) qualify rank <= 10")
def retrieval_knn(spark, sf):
    return retrieval.knn(_points(spark, sf), _asked(spark, sf), 10)


@query(f"select query_id, id, row_number() over (partition by query_id order by score desc, id) as rank, score from ({_KNN} where p.label in (1, 3, 5)) where score >= 0.1 and id <> query_id qualify rank <= 5")
def retrieval_knn_filtered(spark, sf):
    return retrieval.knn(_points(spark, sf).where("document_id in (1, 3, 5)"), _asked(spark, sf), 5, 0.1, exclude_self=True)


@query(
    f"""with k as (select query_id, id, score from ({_KNN}) where id <> query_id qualify row_number() over (partition by query_id order by score desc, id) = 1)
select count(*) as sampled, round(count(*) filter (a.label = b.label) / greatest(count(*), 1), 6) as share_own, round(avg(score) filter (a.label <> b.label), 5) as mean_other
from k join embeddings a on a.vec_id = query_id join embeddings b on b.vec_id = id"""
)
def audit_agreement(spark, sf):
    return retrieval.agreement(retrieval.knn(_points(spark, sf), _asked(spark, sf), 1, exclude_self=True), _points(spark, sf))


@query(
    """with n as (select sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as n from embeddings)
select round(min(n), 6) as low, round(median(n), 6) as median, round(quantile_disc(n, 0.95), 6) as p95, round(max(n), 6) as high from n"""
)
def audit_norms(spark, sf):
    return retrieval.norms(_points(spark, sf))


@query(
    """with v as (select vec_id as id, [round(embedding[1]::double, 1), 0.5] as e, sha256(cast(label as varchar)) as h from embeddings)
select count(*) as points, count(distinct h) as texts, min(id) as first_id from v group by e having count(distinct h) > 1"""
)
def audit_identical(spark, sf):
    vectors = F.expr("array(round(cast(embedding[0] as double), 1), 0.5D)")
    return retrieval.identical(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), vectors.alias("embedding"), F.sha2(F.col("label").cast("string"), 256).alias("text_hash")))


def _tokens(text: str) -> str:
    return rf"len(regexp_extract_all({text}, '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\s]'))"


@query(rf"select doc_id, cast({_tokens('text')} as int) as tokens from documents")
def text_word_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", strings.word_tokens(F.col("text")).alias("tokens"))


@query(
    rf"""with f as (select doc_id, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) as hash from documents where {_tokens('text')} >= 8)
select hash, count(distinct doc_id) as documents, min(doc_id) as first_id from f group by 1 having count(distinct doc_id) > 1"""
)
def audit_duplicates(spark, sf):
    return retrieval.duplicates(table(spark, sf, "documents").select("doc_id", "text"))


def _line_chunks(spark, sf):
    return table(spark, sf, "lineitem").select((F.col("l_partkey") % 397 + F.col("l_quantity").cast("bigint")).alias("token_count"))


_LINES = "(select l_partkey % 397 + cast(l_quantity as bigint) as token_count from lineitem)"


@query(
    f"""with t as (select token_count, row_number() over (order by token_count) as i, count(*) over () as n from {_LINES})
select count(*) as chunks, min(token_count) as low, min(token_count) filter (i >= greatest(1, round_even(0.5 * n, 0))) as median, min(token_count) filter (i >= greatest(1, round_even(0.95 * n, 0))) as p95,
  max(token_count) as high, count(*) filter (token_count >= 360) as at_ceiling from t"""
)
def audit_distribution(spark, sf):
    return retrieval.distribution(_line_chunks(spark, sf), 400)


@query(
    f"""select cast(b as int) as bucket, cast(b * 50 as int) as low, count(token_count) as chunks from (select unnest(range(12)) as b)
left join {_LINES} on least(11, token_count // 50) = b group by 1, 2"""
)
def audit_histogram(spark, sf):
    return retrieval.histogram(_line_chunks(spark, sf), 400)


_DENSE = "select o_custkey % 5 as connector_id, o_orderkey as doc_id, (o_orderkey % 40) * 1024 / (o_orderkey * 37 % 9000) as density from orders where o_orderkey * 37 % 9000 > 0"


@query(
    f"""with d as ({_DENSE}), m as (select connector_id, median(density) as mid from d group by 1 having count(*) >= 5 and median(density) > 0),
o as (select *, round(case when density > 0 then abs(ln(density / mid)) else 'inf'::double end, 9) as far from d join m using (connector_id) where density > 3 * mid or density < mid / 3)
select connector_id, doc_id, density, row_number() over (partition by connector_id order by far desc, doc_id) as place, count(*) over (partition by connector_id) as n from o qualify place <= 10"""
)
def audit_outliers(spark, sf):
    docs = table(spark, sf, "orders").selectExpr("o_custkey % 5 as connector_id", "o_orderkey as doc_id", "o_orderkey % 40 as chunks", "o_orderkey * 37 % 9000 as size_bytes")
    return retrieval.outliers(docs)


@query("select o_orderkey as id from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as i, count(*) over () as n from orders) where i in (select cast(floor(g * (select count(*) from orders) / 97) as bigint) from range(97) t(g))")
def audit_spread(spark, sf):
    return retrieval.spread(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), 97)


_LISTS = "select l_orderkey as item_id, l_orderkey % 11 = 0 as negative, case when l_orderkey % 22 <> 0 then list(l_partkey order by l_linenumber, l_partkey, l_returnflag) else [] end as retrieved, list(l_partkey order by l_linenumber, l_partkey, l_returnflag) filter (l_returnflag = 'R') as relevant from lineitem group by 1"


def _items(spark, sf):
    line = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag")))
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("item_id")).agg(line.alias("s"))
    found = F.when(F.col("item_id") % 22 != 0, F.col("s.l_partkey"))
    return rows.select("item_id", (F.col("item_id") % 11 == 0).alias("negative"), found.alias("retrieved"), F.transform(F.filter("s", lambda x: x["l_returnflag"] == "R"), lambda x: x["l_partkey"]).alias("relevant"))


def _scored_sql(k: int) -> str:
    said = "len(rel) > 0 and not negative"
    return f"""select item_id, negative, case when {said} then len(list_intersect(list_distinct(top), rel)) / len(rel) end as recall,
  case when negative then cast(len(top) = 0 as double) when {said} then coalesce(len(good) / nullif(len(top), 0), 0.0) end as precision,
  case when {said} then coalesce(1 / good[1], 0.0) end as rr, case when {said} then cast(len(good) > 0 as double) end as hit
from (select *, list_filter(range(1, len(top) + 1), lambda i: list_contains(rel, top[i])) as good
  from (select item_id, negative, retrieved[1:{k}] as top, coalesce(list_distinct(relevant), []) as rel from ({_LISTS})))"""


@query(_scored_sql(3))
def evaluation_scores(spark, sf):
    return evaluation.scored(_items(spark, sf), 3)


@query(
    f"""select count(*) as items, count(*) filter (negative) as negatives, count(*) filter (negative and precision = 1) as clean_negatives, round(avg(recall), 6) as recall,
  round(avg(precision), 6) as precision, round(avg(rr), 6) as rr, round(avg(hit), 6) as hit from ({_scored_sql(3)})"""
)
def evaluation_run(spark, sf):
    return evaluation.run_metrics(evaluation.scored(_items(spark, sf), 3))


@query(
    f"""select a.item_id, case when coalesce(a.hit, 0) > coalesce(b.hit, 0) then 'won' else 'lost' end as outcome, round(a.recall - b.recall, 6) as recall_delta
from ({_scored_sql(1)}) b join ({_scored_sql(3)}) a on a.item_id = b.item_id where coalesce(b.hit, -1) <> coalesce(a.hit, -1)"""
)
def evaluation_diff(spark, sf):
    items = _items(spark, sf)
    return evaluation.diff(evaluation.scored(items, 1), evaluation.scored(items, 3))


def _facts(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("end_user_id"), F.col("event_id").alias("fact_id"), F.expr("(event_id % 10) / 10.0D").alias("confidence"), F.expr("(event_id % 7) / 7.0D").alias("similarity"),
        F.col("ts").alias("last_seen_at"), F.expr("case when event_id % 9 = 0 then ts end").alias("superseded_at"),
        F.expr("case when event_id % 4 = 0 then ts + interval 20 days end").alias("expires_at"), F.expr("event_id % 50 = 1").alias("always"),
    )


_FACTS = f"""with f as (select user_id as end_user_id, event_id as fact_id, (event_id % 10) / 10.0::double as confidence, (event_id % 7) / 7.0::double as similarity, event_id % 50 = 1 as always, ts,
  event_id % 9 <> 0 and (event_id % 4 <> 0 or ts + interval 20 days > timestamp '{NOW}') as live,
  power(0.5::double, greatest(0, epoch(timestamp '{NOW}') - floor(epoch(ts))) / 86400 / 90) as recency from events)"""


@query(
    f"""{_FACTS}, s as (select *, round(similarity * confidence * recency, 9) as score from f where live)
select end_user_id, fact_id, row_number() over (partition by end_user_id order by always desc, case when always then ts end desc nulls last, case when not always then score end desc, fact_id) as place, score from s qualify place <= 5"""
)
def memory_recall(spark, sf):
    return memory.recall(_facts(spark, sf), F.lit(NOW).cast("timestamp_ntz"), 5)


@query(
    f"""{_FACTS}, s as (select *, row_number() over (partition by end_user_id order by live desc, round(confidence * recency, 9) desc, fact_id desc) as place from f)
select end_user_id, fact_id from (select *, count(*) filter (live) over (partition by end_user_id) as n from s)
where case when n > 6 then place > 6 else not live and place > 12 end"""
)
def memory_over_budget(spark, sf):
    return memory.over_budget(_facts(spark, sf), F.lit(NOW).cast("timestamp_ntz"), 6)


@query(
    """select fact_id, coalesce(s, c.at) as superseded_at, case when s is null then c.rep end as replacement_id
from (select event_id as fact_id, case when event_id % 9 = 0 then ts end as s from events)
left join (select l_orderkey, min(l_shipdate) as at, arg_min(l_linenumber, (l_shipdate, l_linenumber)) as rep from lineitem group by 1) c on l_orderkey = fact_id"""
)
def memory_supersede(spark, sf):
    closings = table(spark, sf, "lineitem").selectExpr("l_orderkey as fact_id", "cast(l_shipdate as timestamp_ntz) as at", "l_linenumber as replacement_id")
    return memory.supersede(_facts(spark, sf).select("fact_id", "superseded_at"), closings)


@query(
    f"""{_FACTS}, p as (select vec_id, label, round(list_cosine_similarity(embedding::double[], (select embedding from embeddings where vec_id = 0)::double[]), 6) as score from embeddings),
h as (select * from p where score >= 0.0 order by score desc, vec_id limit 200)
select fact_id, end_user_id, h.score as similarity from h join f on fact_id = vec_id where live"""
)
def memory_similar(spark, sf):
    asked = _asked(spark, sf).where("query_id = 0")
    hits = retrieval.knn(_points(spark, sf), asked, 200, 0.0).select(F.col("id").alias("fact_id"), "score")
    return memory.similar(_facts(spark, sf).drop("similarity"), hits, F.lit(NOW).cast("timestamp_ntz")).select("fact_id", "end_user_id", "similarity")


@query("select conv_id, turn, right(text, 4000) as question from conversations where role = 'user' and trim(text) <> '' qualify row_number() over (partition by conv_id order by turn desc) = 1")
def memory_questions(spark, sf):
    return memory.questions(table(spark, sf, "conversations").dropDuplicates(["conv_id", "turn"]))


@query(
    """with f as (select conv_id, min(turn) filter (role = 'user') as upto from conversations group by 1)
select conv_id, substring(sha256(string_agg(role || ':' || coalesce(text, ''), chr(10) order by turn, role, text)), 1, 32) as session_key from conversations join f using (conv_id) where turn <= upto group by 1"""
)
def memory_session_keys(spark, sf):
    return memory.session_keys(table(spark, sf, "conversations"))


@query(
    """with n as (select *, cast(length(coalesce(text, '')) + length(coalesce(role, '')) + 2 as int) as n, row_number() over (partition by conv_id order by turn desc) as p from conversations)
select conv_id, turn, role, n from (select *, sum(n) over (partition by conv_id order by turn desc rows unbounded preceding) as used from n) where used <= 600 or p = 1"""
)
def memory_tail(spark, sf):
    return memory.tail(table(spark, sf, "conversations"), 600)


@query(None)
def memory_route(spark, sf):
    targets = spark.range(3).selectExpr("id as gateway_id", "explode(array(named_struct('priority', 1, 'weight', 70L, 'target', 'a'), named_struct('priority', 2, 'weight', 30L, 'target', 'b'))) as t")
    return memory.route(requests(spark, sf), targets.select("gateway_id", "t.*"))


def _limited(spark, sf):
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.lit(1).alias("cost"))


@query(None)
def limiter_replay(spark, sf):
    return limits.replay(_limited(spark, sf), 3, 86400)


_AT = 1705276800 + 40_000


@query(
    f"""with e as (select user_id as key, cast(floor(epoch(ts)) as bigint) as sec from events)
select key, round(cast(count(*) filter (sec // 86400 = {_AT // 86400 - 1}) * {1 - (_AT % 86400) / 86400!r} + count(*) filter (sec // 86400 = {_AT // 86400}) as double), 6) as used from e
where sec // 86400 in ({_AT // 86400 - 1}, {_AT // 86400}) and sec <= {_AT} group by 1"""
)
def limiter_peek(spark, sf):
    return limits.peek(_limited(spark, sf), 86400, _AT)


@query(
    """with g as (select *, case when ts >= lag(ts) over w + interval 6 hours or lag(ts) over w is null then 1 else 0 end as new from events window w as (partition by user_id order by ts)),
s as (select *, sum(new) over (partition by user_id order by ts range unbounded preceding) as s from g)
select user_id, min(ts) as session_start, max(ts) + interval 6 hours as session_end, count(*) as events from s group by user_id, s"""
)
def stream_sessions(spark, sf):
    return limits.sessions(table(spark, sf, "events"), "6 hours")


@query("select user_id as key, time_bucket(interval 86400 seconds, ts) as bucket, count(*) as failures from events where event_type = 'error' group by all having count(*) > 1")
def stream_failures(spark, sf):
    return limits.failures(table(spark, sf, "events").where("event_type = 'error'").select(F.col("user_id").alias("key"), "ts"), 86400, 1)


@query("select event_id, ts, user_id, event_type from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1")
def stream_latest(spark, sf):
    return limits.latest_per_session(table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type"), ["user_id", "event_type"])


@query(None)
def text_html_sections(spark, sf):
    return text.extract(table(spark, sf, "pages"), "text/html", "html", "page_id")


@query(None)
def text_chunks(spark, sf):
    return text.chunk(table(spark, sf, "documents"), "recursive", 250, 20)


@query(None)
def text_chunks_by_heading(spark, sf):
    return text.chunk(table(spark, sf, "documents"), "by_heading", 250, 20)


@query("select event_id, [1, 2, 3, event_id % 9 + 1, event_id % 9 + 2].list_distinct().list_sort() as handles from events")
def citation_handles(spark, sf):
    said = F.expr("concat('see [1], [3, 2] and [', event_id % 9 + 1, '-', event_id % 9 + 2, '] ```[77]```')")
    return table(spark, sf, "events").select("event_id", strings.handles(said).cast("array<bigint>").alias("handles"))


@query("select p_partkey, 'a: ' || case when p_partkey % 2 = 0 then 'gateway' else 'platform' end || ', b: ' || p_size as settings from part")
def settings_layered(spark, sf):
    """Parameters of three layers; a null layer's value leaves the one below."""
    low, mid = F.expr("map('a', 'platform', 'b', '0')"), F.expr("map('a', case when p_partkey % 2 = 0 then 'gateway' end)")
    top = F.expr("map('b', string(p_size))")
    merged = strings.layered(low, mid, top)
    return table(spark, sf, "part").select("p_partkey", F.concat(F.lit("a: "), merged["a"], F.lit(", b: "), merged["b"]).alias("settings"))


@query(
    """with s as (select vec_id, label, vec_id % 3 as v from embeddings) select vec_id, label, v from s where label not in (2, 4) union all select vec_id + 100000, label, 9 from s where label in (2, 4) and vec_id % 2 = 0"""
)
def lifecycle_replace_document(spark, sf):
    points = table(spark, sf, "embeddings").selectExpr("vec_id", "label as document_id", "vec_id % 3 as v")
    new = points.where("document_id in (2, 4) and vec_id % 2 = 0").selectExpr("vec_id + 100000 as vec_id", "document_id", "cast(9 as bigint) as v")
    return lifecycle.replace_document(points, new).withColumnRenamed("document_id", "label")


@query(None)
def text_sentence_windows(spark, sf):
    return text.chunk(table(spark, sf, "documents"), "sentence_window")


@query(None)
def retrieval_dedupe(spark, sf):
    kinds = F.when(F.col("id") % 25 == 0, "summary").otherwise("source")
    found = retrieval.knn(_points(spark, sf), _asked(spark, sf), 50).join(_points(spark, sf).select("id", "document_id"), "id")
    return retrieval.dedupe(found.select("query_id", "id", "document_id", (F.col("id") % 40).alias("chunk_index"), F.lit(1).alias("radius"), "score", F.concat(F.lit("t"), (F.col("id") % 60).cast("string")).alias("text"), kinds.alias("kind")))


@query(
    rf"""with s as (select conv_id as query_id, turn as rank, sum({_tokens('text')}) over (partition by conv_id order by turn rows unbounded preceding) as used from conversations)
select query_id, rank, cast(used as bigint) as used from s where used <= 120"""
)
def retrieval_fit(spark, sf):
    return retrieval.fit(table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text"), 120).select("query_id", "rank", "used")


@query(
    r"""select doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''),
  '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), 'sk-[A-Za-z0-9]{16,}', '[KEY]', 'g'), '\d{3}-\d{2}-\d{4}', '[SSN]', 'g'), '(?:\d[ -]?){13,16}', '[CARD]', 'g')) as redacted_sha256 from documents"""
)
def text_redact(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(strings.redact(F.coalesce("text", F.lit(""))), 256).alias("redacted_sha256"))
