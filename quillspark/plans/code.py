"""Registered queries over source files, which are made from the lines of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import code
from quillspark.plans.registry import query
from quillspark.sources.tables import table

#: A file's head, one declaration for each line (l, number i) with the line in a comment and a string, and its foot; SQL for Spark and DuckDB.
_FORMS = {
    "python": ("'import os' || nl || 'X = {1: \"}\"}' || nl || nl", "'def part' || i || '(a, b=\"):\"):' || nl || '    \"\"\"' || s || ' \"\"\"' || nl || '    # ' || l || nl || '    return [\"{\", a]' || nl", "nl || 'print(X)' || nl"),
    "javascript": ("'import x from \"y\";' || nl || nl", "'export function part' || i || '(a) {' || nl || '  // ' || l || nl || '  if (a) { return \"' || s || '\"; }' || nl || '}' || nl", "nl || '/* } */' || nl"),
    "typescript": ("'type T = string;' || nl", "'const part' || i || ' = async (a) => {' || nl || '  // ' || l || nl || '  return \"' || s || '\";' || nl || '};' || nl", "'export default x;' || nl"),
    "go": ("'package p' || nl || nl", "'func (s *Doc) part' || i || '(a int) string {' || nl || '  // ' || l || nl || '  return \"' || s || '\"' || nl || '}' || nl", "nl || 'var x = 1' || nl"),
}
_NAMES = tuple(_FORMS)


def _whole(form: tuple[str, str, str]) -> str:
    head, each, foot = form
    return f"{head} || array_join(transform(lines, (raw, i) -> transform(array(named_struct('l', raw, 's', replace(replace(raw, '\\\\', '\\\\\\\\'), '\"', '\\\\\"'))), x -> {each.replace('|| l ||', '|| x.l ||').replace('|| s ||', '|| x.s ||')})[0]), '') || {foot}".replace(" nl", " '\\n'").replace("(nl", "('\\n'")


def sources(spark, sf):
    """doc_id, language, text: a source file for each document, with a declaration a line of its text."""
    docs = table(spark, sf, "documents").selectExpr("doc_id", "split(coalesce(text, ''), '\\n') as lines")
    cases = " ".join(f"when {i} then {_whole(form)}" for i, form in enumerate(_FORMS.values()))
    names = ", ".join(f"'{n}'" for n in _NAMES)
    return docs.selectExpr("doc_id", f"element_at(array({names}), int(doc_id % 4) + 1) as language", f"case doc_id % 4 {cases} end as text")


def _duck(k: int) -> str:
    head, each, foot = (x.replace("nl", "chr(10)") for x in _FORMS[_NAMES[k]])
    header = {
        "python": "'def part' || i || '(a, b=\"):\"):'", "javascript": "'export function part' || i || '(a) {'", "typescript": "'const part' || i || ' = async (a) => {'", "go": "'func (s *Doc) part' || i || '(a int) string {'",
    }[_NAMES[k]]
    name = ("'Doc.part' || i" if _NAMES[k] == "go" else "'part' || i")
    first = "'T'" if _NAMES[k] == "typescript" else "cast(null as varchar)"
    title = "'type T = string;'" if _NAMES[k] == "typescript" else "''"
    return f"""select doc_id, -1 as i, {head} as t, {first} as name, {title} as header from d where doc_id % 4 = {k}
  union all select doc_id, i, {each}, {name}, {header} from l where doc_id % 4 = {k}
  union all select doc_id, 1000000000, {foot}, null, '' from d where doc_id % 4 = {k}"""


@query(
    f"""with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, unnest(range(len(lines))) as i, unnest(lines) as l, replace(replace(unnest(lines), chr(92), chr(92) || chr(92)), '"', chr(92) || '"') as s from d),
u as ({" union all ".join(_duck(k) for k in range(4))})
select doc_id, cast(row_number() over w - 1 as integer) as unit, cast(coalesce(sum(length(t)) over (w rows between unbounded preceding and 1 preceding), 0) as bigint) as start, cast(sum(length(t)) over w as bigint) as end_,
  name, header, sha256(t) as text_sha256 from u window w as (partition by doc_id order by i)"""
)
def code_declarations(spark, sf):
    """The units of every file, however long it is, which tile it."""
    found = code.declarations(sources(spark, sf), None)
    return found.select("doc_id", "unit", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end_"), "name", "header", F.sha2("text", 256).alias("text_sha256"))


@query(None)
def code_chunks(spark, sf):
    return code.chunk(sources(spark, sf), 120, most_chars=None)
