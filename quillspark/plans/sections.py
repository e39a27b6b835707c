"""Registered queries over sections, sentences and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import tokens
from quillspark.operators import sections, text
from quillspark.plans.registry import query
from quillspark.sources.tables import table

_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _plain(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id", "0 as section", "'' as title", "text")


@query(
    f"""with t as (select doc_id, trim(coalesce(text, ''), {_TRIM}) as t from documents),
s as (select doc_id, list_filter(string_split(regexp_replace(t, '([.!?]["'')\\]]{{0,64}}\\s)', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as p from t),
i as (select doc_id, p, unnest(range(len(p))) as i from s),
e as (select doc_id, i, trim(p[i + 1], {_TRIM}) as e, trim(array_to_string(p[greatest(i - 2, 0) + 1:least(i + 2, len(p) - 1) + 1], ''), {_TRIM}) as t from i)
select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as integer) as chunk_index, sha256(t) as text_sha256, e as embedded from e where e <> ''"""
)
def section_sentence_windows(spark, sf):
    """Every sentence of every document with two neighbours to either side."""
    made = sections.sentence_windows(_plain(spark, sf), 1_000_000, 2)
    return made.select("doc_id", "chunk_index", F.sha2("text", 256).alias("text_sha256"), "embedded")


@query(None)
def section_sentence_windows_cut(spark, sf):
    """The same where a sentence may hold 40 tokens at most."""
    return sections.sentence_windows(_plain(spark, sf), 40, 2)


@query(None)
def section_chunks_by_heading(spark, sf):
    """Chunks of the sections of web pages, with the path of headings above each."""
    pages = text.extract(table(spark, sf, "pages").selectExpr("page_id as doc_id", "html as text"), "text/html")
    return sections.by_heading(pages, 60, 10)


@query(None)
def section_chunks_whole(spark, sf):
    """Chunks over whole pages by tokens of four characters, with the title of the section in which each begins."""
    pages = text.extract(table(spark, sf, "pages").selectExpr("page_id as doc_id", "html as text"), "text/html")
    return sections.whole(pages, 80, 10, tokens.Approximate(4))


@query(None)
def token_offsets(spark, sf):
    """Where the tokens of every document begin, by three tokenizers."""
    import public_tokenizers

    docs = table(spark, sf, "documents").selectExpr("doc_id as id", "text")
    kinds = (tokens.WORDS, tokens.Approximate(3.7), tokens.BytePairs(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "byte_bpe_50k"))
    parts = [tokens.token_offsets(docs, k).select("id", F.lit(k.name).alias("tokenizer"), (F.size("offsets") - 1).alias("tokens"), F.sha2(F.concat_ws(",", F.col("offsets").cast("array<string>")), 256).alias("offsets_sha256")) for k in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
