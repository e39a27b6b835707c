"""Registered queries over index versions, batches for an embedder and whatever else is built beside what is in use."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import batches, rebuild
from quillspark.plans.registry import query
from quillspark.sources.shared import shared_folder
from quillspark.sources.tables import table

POINT = "id bigint, connector_id bigint, embedding array<double>"


@query(
    """with v as (select vec_id as id, label as connector_id, list_transform(embedding, lambda x: round(cast(x as double) * 2, 6)) as e from embeddings)
select id, connector_id, len(e) as width, e[1] as first_, e[64] as last_ from v where connector_id <> 3
union all select id + 1000000, connector_id, len(e), e[2], null from (select id, connector_id, list_slice(e, 1, 64) as e from v where connector_id = 3)"""
)
def index_rebuilt(spark, sf):
    """What readers get after a rebuild: all points embedded anew but those of connector 3, which was cut anew, under one flip."""
    points = table(spark, sf, "embeddings").selectExpr("vec_id as id", "bigint(label) as connector_id", "cast(embedding as array<double>) as embedding")
    index = rebuild.Index(spark, shared_folder(spark, "index"), POINT, 4)
    index.promote("v1", index.copy(points, "v1", lambda p: p), 64)
    twice = lambda p: p.withColumn("embedding", F.expr("transform(embedding, x -> round(x * 2, 6))"))
    recut = spark.createDataFrame([(3,)], "connector_id bigint")
    expected = index.copy(index.read(), "v2", twice, recut)
    # Connector 3's documents come anew: other ids, vectors turned by a place.
    new = twice(points.where("connector_id = 3")).selectExpr("id + 1000000 as id", "connector_id", "concat(slice(embedding, 2, 63), array(cast(null as double))) as embedding")
    index.promote("v2", expected + index.add(new, "v2"), 64)
    return index.read().selectExpr("id", "connector_id", "bigint(size(embedding)) as width", "embedding[0] as first_", "embedding[63] as last_")


@query(
    """with recursive t as (select doc_id as id, cast(coalesce(length(text), 0) as bigint) as cost, row_number() over (order by doc_id) as n from documents),
b as (select n, cost as used, 1 as held, 0 as batch, id from t where n = 1
  union all select t.n, case when held >= 32 or used + t.cost > 60000 then t.cost else used + t.cost end, case when held >= 32 or used + t.cost > 60000 then 1 else held + 1 end,
    case when held >= 32 or used + t.cost > 60000 then batch + 1 else batch end, t.id from b join t on t.n = b.n + 1)
select id, cast(batch as bigint) as batch, cast(held - 1 as integer) as place from b"""
)
def embedding_batches(spark, sf):
    """Texts of all documents in batches for an embedder: 32 of them or 60000 characters."""
    texts = table(spark, sf, "documents").selectExpr("doc_id as id", "length(text) as cost")
    return batches.greedy(texts, 32, 60_000)


@query("select vec_id as id, label from embeddings where vec_id > 99 order by vec_id limit 50")
def index_scroll(spark, sf):
    points = table(spark, sf, "embeddings").selectExpr("vec_id as id", "label")
    return rebuild.scroll(points, 99, 50)


@query("select label as connector_id, count(*) as points from embeddings where label is distinct from 4 group by 1")
def index_without_connector(spark, sf):
    points = table(spark, sf, "embeddings").selectExpr("vec_id as id", "label as connector_id")
    return rebuild.without_connector(points, 4).groupBy("connector_id").agg(F.count("*").alias("points"))
