"""Registered queries over evaluation runs at every level, and over bodies redacted by their gateways' patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import evaluation, scrub
from quillspark.plans.registry import query
from quillspark.sources.tables import table

_LINES = """l as (select l_orderkey as item_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) as rank,
  l_partkey as chunk_id, l_suppkey as document_id, cast(l_quantity as bigint) as tokens, l_returnflag, l_linestatus from lineitem)"""


def _items(spark, sf, budget):
    lines = spark.sql(f"with {_LINES.replace('from lineitem', 'from {lines}')} select * from l", lines=table(spark, sf, "lineitem"))
    found = evaluation.injected(lines.where("item_id % 22 <> 0"), budget)
    retrieved = found.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "document_id", "injected"))).alias("retrieved"))
    labels = lines.where("l_returnflag = 'R' and item_id % 11 <> 0 and item_id % 3 <> 0")
    chunks = labels.groupBy("item_id").agg(F.sort_array(F.collect_set("chunk_id")).alias("relevant_chunks"))
    named = lines.where("l_linestatus = 'O' and rank = 2 and item_id % 11 <> 0").select("item_id", "document_id")
    documents = evaluation.relevant_documents(labels, named)
    items = lines.select("item_id").distinct().withColumn("verified", F.expr("item_id % 4 = 0"))
    return items.join(retrieved, "item_id", "left").join(chunks, "item_id", "left").join(documents, "item_id", "left").withColumn("retrieved", F.coalesce("retrieved", F.expr("cast(array() as array<struct<rank:int,chunk_id:bigint,document_id:bigint,injected:boolean>>)")))


def _level_sql(k: int, budget: int) -> str:
    one = lambda level, kind, cond: f"""select '{level}' as level, i.item_id, i.verified, i.negative, count(f.id) as top, count(*) filter (f.id is not null and r.id is not null) as good,
    count(distinct f.id) filter (r.id is not null) as found, min(f.place) filter (r.id is not null) as first, any_value(n.n) as n
  from i left join (select item_id, {kind}_id as id, row_number() over (partition by item_id order by rank) as place from f where rank <= {k} and {cond}) f on f.item_id = i.item_id
    left join rel_{kind} r on r.item_id = i.item_id and r.id = f.id left join (select item_id, count(*) as n from rel_{kind} group by 1) n on n.item_id = i.item_id group by all"""  # noqa: E731
    levels = " union all ".join((one("chunk", "chunk", "true"), one("chunk_injected", "chunk", "injected"), one("document", "document", "true"), one("document_injected", "document", "injected")))
    return f"""with {_LINES},
f as (select *, sum(tokens) over (partition by item_id order by rank) <= {budget} as injected from l where item_id % 22 <> 0),
lab as (select * from l where l_returnflag = 'R' and item_id % 11 <> 0 and item_id % 3 <> 0),
rel_chunk as (select distinct item_id, chunk_id as id from lab),
rel_document as (select item_id, document_id as id from lab union select item_id, document_id from l where l_linestatus = 'O' and rank = 2 and item_id % 11 <> 0),
i as (select item_id, item_id % 4 = 0 as verified, item_id not in (select item_id from rel_document) as negative from (select distinct item_id from l)),
s as ({levels}),
m as (select level, item_id, verified, negative, case when not negative and n > 0 then found / n end as recall,
  case when negative then cast(top = 0 as double) when n > 0 then coalesce(good / nullif(top, 0), 0.0) end as precision, case when not negative and n > 0 then coalesce(1 / first, 0.0) end as rr,
  case when not negative and n > 0 then cast(good > 0 as double) end as hit from s),
p as (select 'all' as population, * from m union all select 'verified', * from m where verified),
r as (select population, level, count(*) as items, count(recall) as scored, count(*) filter (negative) as negatives, count(*) filter (negative and precision = 1) as clean_negatives,
  round(avg(recall), 6) as recall, round(avg(precision), 6) as precision, round(avg(rr), 6) as rr, round(avg(hit), 6) as hit from p group by 1, 2)"""


@query(_level_sql(3, 60) + " select * from r")
def evaluation_levels(spark, sf):
    """A run's metrics by chunk and by document, before and after the prompt's budget, over all items and the verified ones."""
    return evaluation.run_levels(evaluation.level_scores(_items(spark, sf, 60), 3))


@query(_level_sql(3, 60) + " select level, item_id, verified, negative, recall, precision, rr, hit from m")
def evaluation_level_scores(spark, sf):
    return evaluation.level_scores(_items(spark, sf, 60), 3).select("level", "item_id", "verified", "negative", "recall", "precision", "rr", "hit")


@query(
    r"""with t as (select doc_id, doc_id % 3 as g, coalesce(text, '') as t from documents),
r as (select doc_id, g, case when g = 0 then regexp_replace(regexp_replace(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[redacted]', 'g'), '[0-9]{3}-[0-9]{4}', '[redacted]', 'g')
  when g = 1 then regexp_replace(t, '(th|an)e?', '[redacted]', 'g') else t end as t from t)
select doc_id, 'text@example.com' as key_, sha256(t) as text_sha256, sha256(replace(t, 'x', 'y')) as inner_sha256, true as complete from r"""
)
def bodies_scrubbed(spark, sf):
    """Texts of all documents in nested bodies, redacted by the patterns of three gateways; keys stay."""
    docs = table(spark, sf, "documents").selectExpr("doc_id", "bigint(doc_id % 3) as gateway_id", "coalesce(text, '') as t")
    text, inner = "from_json(to_json(array(t)), 'array<string>')[0]", "t"
    bodies = docs.selectExpr("doc_id", "gateway_id", f"concat('{{\"text@example.com\" : ', substring(to_json(array({text})), 2, length(to_json(array({text}))) - 2), ', \"n\": [1, {{\"deep\": [', substring(to_json(array({inner})), 2, length(to_json(array({inner}))) - 2), ', null, 2.50]}}]}}') as body")
    gateways = spark.createDataFrame([(0, [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[0-9]{3}-[0-9]{4}", "(a+)+$", " "]), (1, ["(th|an)e?"]), (2, None)], "gateway_id bigint, patterns array<string>")
    done = scrub.scrubbed(bodies, gateways)
    told = F.from_json("body", "struct<`text@example.com`:string,n:array<string>>")
    deep = F.from_json(told["n"][1], "struct<deep:array<string>>")["deep"][0]
    return done.select("doc_id", F.regexp_extract("body", r'^\{"([^"]*)" : ', 1).alias("key_"), F.sha2(told["text@example.com"], 256).alias("text_sha256"), F.sha2(F.replace(deep, F.lit("x"), F.lit("y")), 256).alias("inner_sha256"), "complete")
