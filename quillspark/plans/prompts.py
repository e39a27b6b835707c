"""Registered queries of prompt assembly, citations and the hash embedder."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import embedding
from quillspark.operators import prompts, retrieval
from quillspark.plans.queries import _tokens
from quillspark.plans.registry import query
from quillspark.sources.tables import table

_TRIMMED = r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')"
_ONE = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
_DOC_HEAD = f"{prompts.HEADING}\n{prompts.INSTRUCTION}".replace("'", "''")


def _chunks(spark, sf):
    return table(spark, sf, "conversations").dropDuplicates(["conv_id", "turn"]).select(
        F.col("conv_id").alias("id"), (F.col("turn") + 1).alias("place"), F.col("role").alias("source_name"), F.expr("case when turn % 2 = 0 then concat('p. ', turn) end").alias("section"), "text",
        (F.col("turn") % 5 == 4).alias("is_summary"),
    )


_CHUNKS = """c as (select conv_id as id, turn + 1 as place, role, turn, text,
  case when turn % 5 = 4 then '[' || (turn + 1) || '] summary of: ' || role else '[' || (turn + 1) || '] source: ' || role || case when turn % 2 = 0 then ' (p. ' || turn || ')' else '' end end
  || chr(10) || {body} as line, '- ' || {one} as bullet from (select distinct on (conv_id, turn) * from conversations))""".format(body=_TRIMMED, one=_ONE)


@query(f"with {_CHUNKS} select id, place, line from c")
def prompt_entries(spark, sf):
    rows = _chunks(spark, sf)
    return rows.select("id", "place", prompts.entry(F.col("place"), F.col("source_name"), F.col("section"), F.col("text"), F.col("is_summary")).alias("line"))


@query(
    f"""with {_CHUNKS}, u as (select *, {_tokens(f"'{_DOC_HEAD}'")} + sum({_tokens("line")}) over (partition by id order by place) as used from c)
select id, place, cast(used as bigint) as used, used <= 150 as kept from u"""
)
def prompt_fit_documents(spark, sf):
    return prompts.fit_documents(_chunks(spark, sf), "id", F.lit(150)).select("id", "place", "used", "kept")


@query(
    f"""with {_CHUNKS}, u as (select *, {_tokens(f"'{_DOC_HEAD}'")} + sum({_tokens("line")}) over (partition by id order by place) as used from c)
select id, '{_DOC_HEAD}' || chr(10) || chr(10) || string_agg(line, chr(10) || chr(10) order by place) as text, cast(max(used) as bigint) as tokens, cast(count(*) as int) as kept from u where used <= 150 group by 1"""
)
def prompt_documents_block(spark, sf):
    return prompts.render_documents(prompts.fit_documents(_chunks(spark, sf), "id", F.lit(150)), "id")


@query(
    f"""with {_CHUNKS}, u as (select *, {_tokens(f"'{prompts.MEMORY_HEADING}'")} + sum({_tokens("bullet")}) over (partition by id order by place) as used from c where bullet <> '- ')
select id, '{prompts.MEMORY_HEADING}' || chr(10) || string_agg(bullet, chr(10) order by place) as text, cast(max(used) as bigint) as tokens, cast(count(*) as int) as kept from u where used <= 90 group by 1"""
)
def prompt_facts_block(spark, sf):
    return prompts.render_facts(prompts.fit_facts(_chunks(spark, sf), "id", F.lit(90)), "id")


@query(
    f"""with {_CHUNKS}, q as (select id, 40 + id % 200 as base, case when id % 3 > 0 then 500 end as win, 150 as dmax, 90 as mmax from (select distinct conv_id as id from conversations)),
q2 as (select *, case when win is not null then greatest(0, win - base - 256) end as room from q),
d as (select c.id, c.place, c.line, {_tokens(f"'{_DOC_HEAD}'")} + sum({_tokens("line")}) over (partition by c.id order by place) as used from c),
dk as (select d.id, '{_DOC_HEAD}' || chr(10) || chr(10) || string_agg(line, chr(10) || chr(10) order by place) as documents, cast(count(*) as int) as injected, max(used) as dt from d join q2 on q2.id = d.id where used <= least(dmax, room) group by 1),
q3 as (select q2.*, documents, coalesce(injected, 0) as injected, coalesce(dt, 0) as dt from q2 left join dk on dk.id = q2.id),
f as (select c.id, c.place, c.bullet, {_tokens(f"'{prompts.MEMORY_HEADING}'")} + sum({_tokens("bullet")}) over (partition by c.id order by place) as used from c where bullet <> '- '),
fk as (select f.id, '{prompts.MEMORY_HEADING}' || chr(10) || string_agg(bullet, chr(10) order by place) as memory, cast(count(*) as int) as n, max(used) as mt from f join q3 on q3.id = f.id where used <= greatest(0, least(mmax, room - dt)) group by 1)
select q3.id, documents, memory, injected, coalesce(n, 0) as injected_facts, case when room < dmax then 'context_window' else 'doc_max_tokens' end as documents_bound,
  case when room - dt < mmax then 'context_window' else 'memory_max_tokens' end as memory_bound, cast(base + dt + coalesce(mt, 0) as bigint) as prompt_tokens from q3 left join fk on fk.id = q3.id"""
)
def prompt_assembled(spark, sf):
    asked = table(spark, sf, "conversations").select(F.col("conv_id").alias("id")).distinct()
    asked = asked.selectExpr("id", "40 + id % 200 as base_tokens", "case when id % 3 > 0 then 500 end as context_window", "150 as doc_max_tokens", "90 as memory_max_tokens")
    return prompts.assembled(asked, _chunks(spark, sf), _chunks(spark, sf).select("id", "place", "text"))


def _answers(spark, sf):
    said = "concat('See [', event_id % 7, '] and [', event_id % 5, '-', event_id % 9, '][2], not a[1] or m[1][2].\\n```\\n[3]\\n```\\nAs [^4] or [1, 12] say; [9-2], [1-99].')"
    return table(spark, sf, "events").selectExpr("event_id as id", f"{said} as text", "4 as injected")


@query(None)
def citation_resolved(spark, sf):
    return prompts.resolved(_answers(spark, sf))


@query(
    "select l_orderkey as id, chr(10) || chr(10) || 'Sources:' || chr(10) || string_agg('[' || l_linenumber || '] ' || l_partkey || '.pdf', chr(10) order by l_linenumber, l_partkey || '.pdf') as footer from (select distinct l_orderkey, l_linenumber, l_partkey from lineitem) group by 1"
)
def citation_footer(spark, sf):
    cited = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    cited = cited.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("place"), F.col("l_linenumber").alias("handle"), F.concat(F.col("l_partkey").cast("string"), F.lit(".pdf")).alias("label"))
    return prompts.footer(cited, "id")


@query(None)
def text_embedded(spark, sf):
    """Every text as a vector, with what the vectors must be: of unit length."""
    return embedding.embed(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


@query(None)
def text_search(spark, sf):
    """From text to neighbours: benchmark items ask, all documents answer."""
    points = embedding.embed(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))
    items = table(spark, sf, "benchmark").select(F.xxhash64("item_id").alias("id"), "text")
    return retrieval.knn(points, embedding.embed(items).select(F.col("id").alias("query_id"), F.col("embedding").alias("query")), 5)
