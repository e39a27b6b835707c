"""Work that grows no faster than the tables: short slices, tables read once, keys dealt apart."""

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.functions import slices, tokens
from quillspark.operators import code, evaluation, preview, quotas, reconciliation, retrieval, scrub, sections, semantic, threads
from quillspark.streaming import replayed
from tests.test_upkeep import semantic_plainly


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_slices_hold_few_characters_and_all_rows():
    frame = pd.DataFrame({"id": range(4000), "text": ["x" * 2000, None, "", "y" * (1 << 21)] * 1000})
    cut = list(slices.slices([frame[:60], frame[:0], frame[60:90]]))
    assert max(len(c) for c in slices.slices([frame[frame["text"] == ""]])) == slices.ROWS
    assert all(c["text"].str.len().sum() <= slices.CHARS or c["text"].str.len().max() > slices.CHARS and len(c) == 1 for c in cut)
    assert pd.concat(cut)["id"].tolist() == list(range(90)) and list(slices.bounds([])) == []


def test_token_offsets_leave_python_in_slices(spark, monkeypatch):
    docs = spark.createDataFrame([(i, None if i % 7 == 0 else "a bc " * i) for i in range(300)], "id bigint, text string").coalesce(1)
    monkeypatch.setattr(slices, "ROWS", 11)
    got = {r.id: r.offsets for r in tokens.token_offsets(docs, tokens.WORDS).collect()}
    assert got == {i: tokens.WORDS.offsets("" if i % 7 == 0 else "a bc " * i).tolist() for i in range(300)}


def test_semantic_vectors_stay_in_their_task(spark):
    rows = spark.createDataFrame([(k, 0, "One cat sat. " * k + "Two dogs ran.") for k in range(1, 40)], "doc_id bigint, section int, text string")
    made = semantic.distances(semantic.spans(rows))
    assert "array<double>" not in plan(made).replace("apart", "") and "embedding" not in plan(made)
    got = {r.doc_id: [s.distance for s in r.spans] for r in made.collect()}
    assert all(d[0] is None and d[1:-1] == [0.0] * (k - 1) and d[-1] > 0.5 for k, d in got.items())


def test_semantic_looks_at_every_sentence(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    long = "".join(" ".join(rng.choice(words[20 * (i // 5 % 2) :][:20], 6)) + ". " for i in range(3200))
    rows = spark.createDataFrame([(1, 0, long), (2, 0, "One. Two.")], "doc_id bigint, section int, text string")
    got = [r.text for r in semantic.chunks(rows, 60, percentile=80, floor=5).where("doc_id = 1").orderBy("chunk_index").collect()]
    assert got == semantic_plainly([(0, long)], 60, 80, 5, False) and len(got) > 400
    assert sum(t.count(".") for t in got) == 3200


def test_preview_reads_its_documents_once(spark):
    docs = spark.createDataFrame([(k, "w " * k) for k in range(50)], "doc_id bigint, text string")
    some = tuple(preview.Candidate(str(n), n) for n in (3, 7, 20))
    made = preview.compared(preview.chunks(docs, some), some)
    assert plan(made).count("MapInPandas") == 1
    got = {r.candidate: (r.chunks, r.documents, r.tokens, r.high) for r in made.collect()}
    assert got == {str(n): (sum(-(-k // n) for k in range(50)), 49, sum(range(50)), min(n, 49)) for n in (3, 7, 20)}


def test_sentence_windows_are_not_dealt(spark):
    rows = spark.createDataFrame([(k, s, f"t{s}", "Ab c. De f!  G. " * (k + s) + ("long " * 30 if s == 1 else "")) for k in range(9) for s in range(3)], "doc_id bigint, section int, title string, text string")
    made = sections.sentence_windows(rows, 12, 1)
    assert re.findall(r"\bUnion\b|\bGenerate\b|\bWindow\b", plan(made)) == ["Generate", "Window", "Union"]
    got = made.orderBy("doc_id", "chunk_index").collect()
    for k in range(9):
        mine = [r for r in got if r.doc_id == k]
        assert [r.chunk_index for r in mine] == list(range(len(mine))) and [r.title for r in mine] == sorted(r.title for r in mine)
        assert sum(len(r.embedded.split()) for r in mine) == sum(5 * (k + s) for s in range(3)) + 30


def test_chunks_without_a_shared_block_are_passed_over():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        wanted, body = ("".join(rng.choice(list("abc"), n)) for n in rng.integers(0, 14, 2))
        least = int(rng.integers(1, 6))
        shares = any(body[i : i + least] in wanted for i in range(len(body) - least + 1))
        assert not shares or threads._may_share(wanted, body, least)
    assert not threads._may_share("x" * 160, "y" * 5000, 60) and not threads._may_share("x" * 160, "x" * 59, 60)


def test_bodies_of_one_gateway_are_dealt_apart(spark):
    bodies = spark.range(500).selectExpr("id", "1L as gateway_id", "concat('{\"a\": \"x', id, '\"}') as body")
    keys = "".join(re.findall(r"Join LeftOuter.*", plan(scrub.scrubbed(bodies, spark.createDataFrame([(1, ["x1"])], "gateway_id bigint, patterns array<string>")))))
    assert "_share" in keys
    done = scrub.scrubbed(bodies, spark.createDataFrame([(1, ["x1"])], "gateway_id bigint, patterns array<string>"))
    assert done.count() == 500 and done.where("body like '%redacted%'").count() == 111 and done.columns[-2:] == ["body", "complete"]


def test_levels_are_made_from_one_reading(spark):
    items = spark.createDataFrame([(1, True, [(7, 8, True)], [7], [8])], "item_id bigint, verified boolean, retrieved array<struct<chunk_id:bigint,document_id:bigint,injected:boolean>>, relevant_chunks array<bigint>, relevant_documents array<bigint>")
    made = evaluation.level_scores(items, 3)
    assert "Union" not in plan(made) and "Join" not in plan(made)
    assert sorted(r.level for r in made.collect()) == sorted(evaluation.LEVELS)


def test_batches_are_dealt_in_order_from_their_own_files(spark, tmp_path):
    events = spark.range(100).selectExpr("id", "timestamp_seconds(id * 7 % 100) as ts").repartition(3)
    path = str(tmp_path / "in")
    replayed.deal(events, F.col("ts"), 5, path)
    told = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.min("ts"), F.max("ts"), F.count("*").alias("n")).collect()
    assert sorted(r.n for r in told) == [20] * 5 and all((r[2] - r[1]).seconds == 19 for r in told)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(100))


def test_vectors_are_read_without_python_numbers():
    rows = [[float(i), 2.0 * i, 1.0] for i in range(9)]
    for kind in (pa.float32(), pa.float64()):
        column = pa.chunked_array([pa.array(rows[:4], pa.list_(kind)), pa.array(rows[4:], pa.list_(kind))])
        for c in (column, column.slice(2, 5)):
            vectors, lengths = retrieval._matrix(c)
            assert vectors.tolist() == c.to_pylist() and np.allclose(lengths, [np.linalg.norm(r) for r in c.to_pylist()])
    vectors, lengths = retrieval._matrix(pa.chunked_array([pa.array([[1.0], None, [None, 2.0], []], pa.list_(pa.float64()))]))
    assert vectors.tolist() == [[1.0, 0.0], [0.0, 0.0], [0.0, 2.0], [0.0, 0.0]] and lengths.tolist() == [1.0, 0.0, 0.0, 0.0]
    assert len(retrieval._matrix(pa.chunked_array([pa.array([], pa.list_(pa.float64()))]))[0]) == 0


def test_facts_of_one_vector_are_compared_once(spark):
    facts = spark.createDataFrame([(1, i, [1.0, float(i % 2)], 0.5, i != 2) for i in range(1, 7)], "end_user_id bigint, fact_id bigint, embedding array<double>, confidence double, live boolean")
    new = spark.createDataFrame(
        [(1, 10, 1, [0.0, 1.0], 0.5, [1, 3]), (1, 11, 2, [2.0, 2.0], 0.5, []), (1, 12, 3, [1.0, 0.0], 0.5, [4]), (1, 13, 4, [5.0, 0.0], 0.5, [])],
        "end_user_id bigint, candidate_id bigint, place bigint, embedding array<double>, confidence double, supersedes array<bigint>",
    )
    got = [(r.fact_id, r.outcome, r.of_fact) for r in reconciliation.reconcile(facts, new, 0.99).collect()]
    assert got == [(10, "inserted", None), (1, "superseded", 10), (3, "superseded", 10), (11, "deduped", 5), (12, "inserted", None), (4, "superseded", 12), (13, "deduped", 12)]


def test_files_are_dealt_by_their_size(spark, monkeypatch):
    files = spark.range(40).selectExpr("id as doc_id", "'python' as language", "concat(repeat('x = 1\\n', 50), 'def f(a):\\n    return a\\n') as text")
    monkeypatch.setattr(code, "SHARE_BYTES", 1000)
    assert "RepartitionByExpression" in plan(code.declarations(files)) and code._lines(files).rdd.getNumPartitions() == 13
    assert code.declarations(files).count() == 80


def test_files_are_read_once_after_they_are_dealt(spark):
    files = spark.range(9).selectExpr("id as doc_id", "element_at(array('python', 'go', 'rust'), int(id % 3) + 1) as language", "concat('def f(a):\n    return \"{', id, '\"\n') as text")
    for made in (code.declarations(files), code.chunk(files, 20)):
        told = plan(made)
        assert told.count("read(") == 1 and "Filter" not in told[told.rindex("RepartitionByExpression") :]
    # One order by lines and one for parts, runs and units at each level.
    assert len(re.findall(r"\bSort \[", code.declarations(files)._jdf.queryExecution().executedPlan().toString())) <= 5
    assert code.declarations(files).count() == 3 and code.chunk(files, 20).count() == 9


def replayed_rows(events):
    return sorted((tuple(r) for r in quotas.replay(events).collect()), key=repr)


def test_a_gateway_is_replayed_in_slices(spark, monkeypatch):
    """One gateway with most events, small ones, and null, which is one too; no task takes a whole large one, and decisions stay."""
    rule = "named_struct('key', {0}, 'lease', {1}, 'value', double({2}), 'span', {3}, 'cost', double({4}))"
    rules = ", ".join((rule.format("concat('g', g)", "false", 9, 500, "1.5"), rule.format("concat('u', g, id % 7)", "false", 4, 3000, "id % 3"), rule.format("concat('s', g)", "true", 3, 400, "1")))
    events = spark.range(3000).selectExpr("id", "case when id % 10 < 6 then 1 when id % 10 < 8 then 2 + id % 40 when id % 10 = 8 then null end as gateway_id", "string(coalesce(case when id % 10 < 6 then 1 end, -1)) as g")
    kind = "case when id % 7 = 3 then 'settle' when id % 5 = 2 then 'release' else 'consume' end"
    events = events.selectExpr("id + (1L << 60) as event_id", "gateway_id", "id div 4 * 40 as at", f"{kind} as kind", "string(id div 5) as holder", f"array({rules}) as rules").repartition(5)
    taken, plain = [], quotas._decided

    def decided(rows):
        taken.append(rows.where("kind <> 'kept'").groupBy("gateway_id").count().agg(F.max("count")).first()[0])
        return plain(rows)

    monkeypatch.setattr(quotas, "_decided", decided)
    want = replayed_rows(events)
    assert taken == [1800] and {r[1] for r in want} == {True, False} and {(r[2] or "-")[0] for r in want} == {"-", "g", "u", "s"}
    monkeypatch.setattr(quotas, "SLICE", 200)
    assert replayed_rows(events) == want
    assert len(taken) > 8 and max(taken[1:]) <= 400
