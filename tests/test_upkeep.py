"""Conversations, chunks by subject, labels after a recut, excerpts and ids against plain loops, and their edge cases."""

import difflib
import math
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

import quillspark.plans.all  # noqa: F401
from quillspark.functions import configs, payloads
from quillspark.functions.embedding import vector
from quillspark.operators import filetypes, metrics, semantic, threads, upkeep
from quillspark.operators.text import chunks_of
from quillspark.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
TOKEN = re.compile(r"\w+|[^\w\s]")


def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def fold(text):
    return " ".join(text.split()).lower()


def test_point_ids_are_version_5(spark):
    got = {r.doc_id: r.point_id for r in QUERIES["point_ids"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "n_chars").collect()
    assert got == {r.doc_id: str(uuid.uuid5(payloads.NAMESPACE, f"{r.doc_id}:{r.n_chars % 7}")) for r in rows}


def test_timestamps_of_time_ordered_ids(spark):
    row = spark.sql("select '018cc251-f400-7abc-8def-0123456789ab' as id, cast(null as string) as nothing")
    assert tuple(row.select(payloads.timestamp_ms(F.col("id")), payloads.timestamp_ms(F.col("nothing"))).first()) == (0x018CC251F400, None)


def test_log_entries_say_only_what_matters(spark):
    row = spark.sql("select 'c1' as id, 0.12345678d as score, 'source' as kind, false as stale")
    entry = payloads.log_entry({c: F.col(c) for c in row.columns}, F.lit(True), F.lit(None).cast("string"))
    assert row.select(entry).first()[0] == '{"id":"c1","score":0.123457,"injected":true}'


def semantic_plainly(sections, size, percentile, floor, atomic):
    spans = []
    for n, body in sections:
        body = body.strip(" ")
        ends = [m.end() for m in re.finditer(r"(?<=[.!?])[\"')\]]*\s", body)]
        for a, b in zip([0, *ends], [*ends, len(body)], strict=True):
            if a < b:
                spans.append((n, body[a:b]))
    gaps = []
    for (_, a), (_, b) in zip(spans, spans[1:], strict=False):
        gaps.append(round(1 - float(np.dot(vector(a), vector(b)) / (np.linalg.norm(vector(a)) * np.linalg.norm(vector(b)))), 9))
    rank = max(1, math.ceil(percentile * len(gaps) / 100))
    threshold = sorted(gaps)[rank - 1] if gaps else math.inf
    groups, held = [], 0
    for i, (n, s) in enumerate(spans):
        tokens = len(TOKEN.findall(s))
        last = groups[-1] if groups else None
        if last is None or (atomic and last[0] != n) or (held and held + tokens > size) or (gaps[i - 1] > threshold and held >= min(floor, size // 2)):
            groups.append((n, s))
            held = tokens
        else:
            groups[-1] = (last[0], last[1] + ("" if last[0] == n else "\n\n") + s)
            held += tokens
    out = []
    for _, body in groups:
        n = len(TOKEN.findall(body))
        out += [t for t, _ in (chunks_of(body, size) if n > size else [(body.strip(), n)]) if t]
    return out


def test_semantic_chunks_match_a_plain_loop(spark):
    texts = [(k, t) for k, t in docs(spark)[:60]] + [(900, None), (901, ""), (902, "word " * 450), (903, "One. Two? Three!"), (904, 'He said "no." Then went.\tOff.')]
    table = spark.createDataFrame(texts, "doc_id bigint, text string").select("doc_id", F.lit(0).alias("section"), "text")
    for size, percentile, floor in ((200, 90, 40), (30, 50, 5)):
        got = {}
        for r in semantic.chunks(table, size, percentile, floor).orderBy("doc_id", "chunk_index").collect():
            got.setdefault(r.doc_id, []).append(r.text)
        want = {k: c for k, t in texts if t and t.strip() and (c := semantic_plainly([(0, t)], size, percentile, floor, False))}
        assert got == want


def test_atomic_sections_are_never_joined(spark):
    rows = spark.createDataFrame([(1, 0, "A b c."), (1, 1, "D e f."), (1, 2, None)], "doc_id bigint, section int, text string")
    texts = lambda atomic: [r.text for r in semantic.chunks(rows, 100, atomic=atomic).orderBy("chunk_index").collect()]
    assert texts(True) == ["A b c.", "D e f."] and texts(False) == ["A b c.\n\nD e f."]


def test_spans_of_very_long_texts_are_runs(spark):
    rows = spark.createDataFrame([(1, 0, "Yes. " * 4000)], "doc_id bigint, section int, text string")
    out = semantic.spans(rows).collect()
    assert len(out) == math.ceil(4000 / 3) and sum(r.tokens for r in out) == 8000


def test_excerpts_match_a_plain_loop(spark):
    got = {r.id: (r.excerpt, r.tokens, r.truncated) for r in QUERIES["text_excerpts"](spark, SF).collect()}
    for k, t in docs(spark):
        bare = (t or "").strip()
        at = [m.start() for m in TOKEN.finditer(bare)]
        if len(at) <= 120:
            assert got[k] == (bare, len(at), False)
        else:
            assert got[k] == (bare[: at[90]].rstrip() + threads.ELISION + bare[at[-30] :].lstrip(), 120, True)


def test_labels_are_found_again(spark):
    got = {}
    for r in QUERIES["evaluation_reanchored"](spark, SF).collect():
        got.setdefault(r.label_id, []).append((r.place, r.chunk_id))
    for k, t in docs(spark):
        if t is None:
            continue
        wanted, bodies = fold(t[29:189]), [fold(c) for c in t.split("\n")]
        want = []
        if wanted:
            whole = [i for i, b in enumerate(bodies) if wanted in b]
            if whole:
                want = [(0, f"{k}:{whole[0]}")]
            else:
                for i, b in enumerate(bodies):
                    m = difflib.SequenceMatcher(None, wanted, b, autojunk=False).find_longest_match() if b else None
                    if m and m.size >= min(60, max(1, len(wanted) // 2)):
                        want.append((m.a, f"{k}:{i}"))
        assert sorted(got.get(k, [])) == sorted(want), k


def test_exchanges(spark):
    u, a = (lambda x: ("user", x)), (lambda x: ("assistant", x))
    rows = [
        (1, 1, [u("hi")], "hello"),
        (1, 2, [u("hi"), a("hello"), u("more")], "yes"),  # extends, so replaces
        (2, 1, [u("one")], "two"),
        (2, 2, [u("three"), u("one")], None),  # adds what is new
        (3, 1, [("system", "be brief"), u("  "), ("tool", "x")], " "),
        (4, 1, None, None),
        (5, 1, [u("x" * 50), u("y" * 50)], "z" * 100),  # the last turn alone is over the budget
    ]
    table = spark.createDataFrame(rows, "k int, at int, body array<struct<role:string,text:string>>, answer string")
    turns = table.select("k", "at", threads.turns_of(F.col("body"), F.col("answer")).alias("turns"))
    got = {r.k: [t.text for t in r.turns] for r in threads.exchanges(turns, ["k"], "at", budget=60).collect()}
    assert got == {1: ["hi", "hello", "more", "yes"], 2: ["one", "two", "three"], 3: [], 4: [], 5: ["z" * 100]}


def test_file_types_of_odd_heads(spark):
    rows = spark.createDataFrame([(None, "a.md"), (bytearray(b""), None), (bytearray(b"\xff\xd8\xff\xe0"), "notes.txt"), (bytearray(b"a" * 99 + b"\x01"), "x.log"), (bytearray(b"\x01" * 3), "x.txt")], "head binary, name string")
    got = [r[0] for r in rows.select(filetypes.sniff(F.col("head"), F.col("name"))).collect()]
    assert got == ["text/markdown", "text/plain", "image/jpeg", "text/plain", "application/octet-stream"]


def test_changes_tell_missing_from_null(spark):
    fields = "id int, fields map<string,string>"
    before = spark.createDataFrame([(1, {"a": "1", "b": None, "c": None}), (2, None)], fields)
    after = spark.createDataFrame([(1, {"a": "2", "b": None}), (3, {"x": None})], fields)
    got = sorted(tuple(r) for r in upkeep.changes(before, after, "id").collect())
    assert got == [(1, "a", "1", "2", 0), (1, "c", None, None, 0), (3, "x", None, None, 0)]


def test_chunking_configurations():
    config = {"strategy": "recursive", "chunk_size": 400, "overlap": 40, "overrides": {"code": {"strategy": "code"}, "pdf": {"chunk_size": 20}}}
    assert configs.effective(config, "code") == {"strategy": "code", "chunk_size": 400, "overlap": 40}
    with pytest.raises(ValueError):
        configs.effective(config, "pdf")
    plain = {"strategy": "recursive", "chunk_size": 400, "overlap": 40}
    other = {"strategy": "recursive", "chunk_size": 400, "overlap": 40, "overrides": {"code": {"strategy": "semantic"}}, "version": 2}
    assert configs.changed_formats(plain, other, ("code", "html")) == {"code"}
    assert configs.changed_formats(other, other, ("code", "html"), model_changed=True) == {"code"}
    assert configs.changed_formats(plain, plain, ("code", "html"), tokenizer_changed=True) == {"code", "html"}
    assert configs.digest(plain) == configs.digest(plain, embedding_model="m") != configs.digest(plain, tokenizer="t")
    assert len(configs.digest(plain)) == 16


def test_windows_are_checked():
    for start, end, more in (("2024-01-02", "2024-01-02", {}), ("2024-01-01", "2024-06-01", {}), ("2024-01-01", "2024-01-02", {"status_class": "9xx"})):
        with pytest.raises(ValueError):
            metrics.Filters(start, end, **more)
