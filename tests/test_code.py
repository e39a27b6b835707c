"""Declarations of source files: against a parser for Python, a character scanner for braces, and the rule that units tile the file."""

import ast

import pytest

from quillspark.operators import code
from quillspark.plans import code as plans
from quillspark.plans.registry import SQL
from tests.oracle import both

PYTHON = '''"""Doc: def not_me(): pass"""
import os, sys

X = {"a": 1,
     "b": "}"}

# comment above

@dec(1,
     2)
def first(a,
          b="){"):
    """doc

def hidden(): pass
"""
    return a  # trailing

# between

class Big(Base):
    """Docs."""
    attr = 1

    @property
    def one(self):
        def nested():
            return 1
        return nested

    def two(self):
        if x:
            def inner(): pass
        return 2

    tail = 3

async def last(): return 1
def joined(a): \\
    return a


if __name__ == "__main__":
    first()
'''
SCRIPT = """import x from "y";
// function no() {
/* class Not {
*/
export default class Foo extends Bar {
  field = "}";
  constructor(a) {
    this.a = `t ${"{"} {`;
  }
  static async get(x) { return {a: 1}; }
  if (x) { }
}

function two(a,
   b) {
  if (a) { return b }
}
const arrow = async (x) => {
  return x;
};
type T = string;
interface I { a: number }
"""
GO = 'package main\n\nfunc (s *Server) Serve(w io.Writer) error {\n\tfmt.Println("}", `raw \\`)\n\treturn nil\n}\n\ntype T struct {\n\tA int\n}\n\nvar x = 1\nfunc main() { x() }\n'
FILES = [
    (1, "python", PYTHON), (2, "javascript", SCRIPT), (3, "go", GO), (4, "python", PYTHON.replace("\n", "\r\n")), (5, "python", "def f(x):\n    'unterminated\n"),
    (6, "rust", "fn x() {}"), (7, "python", None), (8, "go", "x := 1"), (9, "javascript", "function a() {\n"), (10, "python", "  \n"), (11, "python", ""),
    (12, "typescript", "function a(){" + "x;" * 600 + "}\n"), (13, "python", "def only(): pass"), (14, "go", "func a() {\n}\n" * 40_000),
    (15, "python", 'def f():\n    return "' + '\\"x' * 60_000 + '"\n'), (16, "javascript", "const a = `" + "\\`" * 60_000 + "`;\nfunction b() {}\n"), (17, "python", "@a\n@b\nclass C:\n    x = 1\n\n\n\n# end\n"),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "doc_id bigint, language string, text string").repartition(4)


@pytest.fixture(scope="module")
def units(files):
    out = {}
    for r in code.declarations(files).orderBy("doc_id", "unit").collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_units_tile_the_file(units, files):
    texts = {d: t for d, _, t in FILES}
    assert set(units) == {1, 2, 3, 4, 13, 15, 16, 17}
    for d, rows in units.items():
        assert "".join(r["text"] for r in rows) == texts[d]
        assert [(r["start"], r["end"]) for r in rows] == [(a, a + len(r["text"])) for r, a in zip(rows, (sum(len(x["text"]) for x in rows[:i]) for i in range(len(rows))), strict=True)]
    parts = {}
    for r in code.members(files).orderBy("doc_id", "unit", "part").collect():
        parts.setdefault(r["doc_id"], []).append(r["text"])
    assert {d: "".join(p) for d, p in parts.items()} == {d: texts[d] for d in units}


@pytest.mark.parametrize("doc", [1, 4, 13, 15, 17])
def test_python_by_its_parser(units, doc):
    text = dict((d, t) for d, _, t in FILES)[doc]
    starts = [0]
    for line in text.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    want = []
    for node in ast.parse(text).body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            want.append((node.name, starts[min([node.lineno, *(d.lineno for d in node.decorator_list)]) - 1], text[: starts[node.end_lineno]].rstrip()))
    got = [(r["name"], r["start"], text[: r["end"]].rstrip()) for r in units[doc] if r["name"]]
    assert got == want


def test_braces(units):
    assert [(r["name"], r["header"]) for r in units[2]] == [
        (None, ""), ("Foo", "export default class Foo extends Bar {"), ("two", "function two(a,\n   b) {"), ("arrow", "const arrow = async (x) => {"), ("T", "type T = string;"), ("I", "interface I {"),
    ]
    assert [(r["name"], r["header"]) for r in units[3]] == [(None, ""), ("Server.Serve", "func (s *Server) Serve(w io.Writer) error {"), ("T", "type T struct {"), (None, ""), ("main", "func main() {")]


def test_members(files):
    rows = code.members(files).where("doc_id in (1, 2)").orderBy("doc_id", "unit", "part").collect()
    assert [(r["doc_id"], r["outer_name"], r["name"]) for r in rows if r["name"]] == [(1, "Big", "one"), (1, "Big", "two"), (2, "Foo", "constructor"), (2, "Foo", "get")]
    assert next(r["text"] for r in rows if r["name"] == "one").startswith("    @property\n    def one(self):\n        def nested")


def test_chunks(files):
    rows = code.chunk(files.where("doc_id not in (14, 15, 16)"), 30).orderBy("doc_id", "chunk_index").collect()
    texts = {d: t for d, _, t in FILES}
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == {d for d, t in texts.items() if t and t.strip()} - {14, 15, 16}
    for d, found in by_doc.items():
        assert [r["chunk_index"] for r in found] == list(range(len(found)))
        # Everything but white space is in the chunks, in order, apart from signatures carried along.
        squeezed, at = "".join(texts[d].split()), 0
        for r in found:
            body = "".join(r["text"].split())
            for cut in range(len(body)):
                if squeezed.startswith(body[cut:], at) or squeezed.startswith(body[cut:], max(0, at)):
                    at += len(body) - cut
                    break
        assert at == len(squeezed)
    assert any(r["name"] == "Big.one" and r["text"].startswith("class Big(Base):\n") for r in by_doc[1])


def test_files_without_rows(files):
    assert code.declarations(files.where("false")).count() == 0
    assert code.chunk(files.where("false")).count() == 0


def test_long_files_have_their_declarations(spark, tmp_path):
    """A document's file is beyond MOST_CHARS; the query reads it as its SQL does."""
    rows = [(k, (f'line {k} "of" \\ text ' * 20 + "\n") * 600) for k in range(4)] + [(4, None), (5, "a\n\nb")]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    (part,) = (tmp_path / "documents.parquet").glob("*.parquet")
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "documents.parquet").write_bytes(part.read_bytes())
    files = plans.sources(spark, str(tmp_path))
    assert files.where(f"length(text) > {code.MOST_CHARS}").count() == 4
    mine, theirs = both(spark, plans.code_declarations, SQL["code_declarations"], str(tmp_path / "flat"))
    assert mine == theirs and len(mine[1]) > 2400
    chunks = plans.code_chunks(spark, str(tmp_path)).where("doc_id < 4")
    assert chunks.where("name is null").groupBy("doc_id").count().agg({"count": "max"}).first()[0] < 5
