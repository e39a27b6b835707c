"""Operators on small tables with hand-derived results."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.functions import strings
from quillspark.operators import evaluation, lifecycle, metrics, retrieval, text
import quillspark.plans.all  # noqa: F401
from quillspark.plans.registry import QUERIES
from quillspark.streaming import limits


def test_percentiles_are_discrete_by_the_ceil_rule(spark):
    rows = spark.createDataFrame([(v,) for v in [5, *range(10, 101, 5)]] + [(None,)], "ms int")
    assert tuple(rows.agg(*metrics.percentiles("ms", "p")).first()) == (50, 95, 100)
    assert tuple(rows.where("ms < 0").agg(*metrics.percentiles("ms", "p")).first()) == (None, None, None)


def test_intervals():
    assert [metrics.choose_interval(s) for s in (3600, 7200, 86400, 86401, 8 * 86400, 90 * 86400)] == [60, 60, 300, 1800, 3600, 86400]
    assert metrics.choose_interval(86400, 61) == 300 and metrics.choose_interval(31 * 86400, 60) == 3600


def test_item_scores(spark):
    items = [(1, False, [1, 2, 3, 4, 5, 6], [2, 5, 9]), (2, True, [], []), (3, True, [1], []), (4, None, None, [7]), (5, False, [1, 2, 3, 4, 5, 6, 7], [7]), (6, False, [1], [])]
    got = {r["item_id"]: tuple(r)[1:] for r in evaluation.scored(spark.createDataFrame(items, "item_id int, negative boolean, retrieved array<bigint>, relevant array<bigint>"), 6).collect()}
    assert got[1] == (False, pytest.approx(2 / 3), pytest.approx(2 / 6), 0.5, 1.0)
    assert got[2] == (True, None, 1.0, None, None) and got[3] == (True, None, 0.0, None, None)
    assert got[6] == (False, None, None, None, None)
    assert got[4] == (False, 0.0, 0.0, 0.0, 0.0) and got[5] == (False, 0.0, 0.0, 0.0, 0.0)


def test_limiter_replay_matches_a_plain_loop(spark):
    got = {r["event_id"]: r["allowed"] for r in QUERIES["limiter_replay"](spark, "/root/testdata/sf0.001").collect()}
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_id", "user_id", "unix_seconds(cast(ts as timestamp)) as at").toPandas()
    counts: dict = {}
    for e, user, at in events.sort_values(["user_id", "at", "event_id"]).itertuples(index=False):
        n = at // 86400
        used = counts.get((user, n - 1), 0) * (1 - (at - n * 86400) / 86400) + counts.get((user, n), 0)
        assert got[e] == (used + 1 <= 3)
        if got[e]:
            counts[user, n] = counts.get((user, n), 0) + 1


def test_limiter_over_a_stream_decides_as_the_replay(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr(
        "event_id", "user_id as key", "cast(unix_seconds(cast(ts as timestamp)) as double) as at", "1.0D as cost"
    )
    events.repartition(1).sortWithinPartitions("at").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = limits.limited(stream, 3, 86400).writeStream.format("memory").queryName("decided").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, limits.replay(events, 3, 86400).select("event_id", "allowed").collect()))
    assert sorted(map(tuple, spark.table("decided").select("event_id", "allowed").collect())) == want


def test_log_sink(spark, tmp_path):
    rows = spark.createDataFrame([(1, datetime(2024, 1, 1, 10), "mail a@b.example now"), (2, datetime(2024, 1, 2), None)], "id int, ts timestamp_ntz, body string")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    limits.write_log(stream, f"{tmp_path}/out", f"{tmp_path}/cp", {"body": strings.redact(F.col("body"))}, available_now=True).awaitTermination(60)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("id", F.col("day").cast("string"), "body").collect()))
    assert got == [(1, "2024-01-01", "mail [EMAIL] now"), (2, "2024-01-02", None)]


def test_dedupe(spark):
    rows = [
        (1, 1, 7, 5, 1, 0.9, "a", "source"), (1, 2, 7, 6, 1, 0.8, "b", "source"), (1, 3, 7, 7, 1, 0.7, "c", "source"), (1, 4, 8, 1, 1, 0.6, " A ", "source"),
        (1, 5, 7, 5, 1, 0.5, "a", "summary"), (1, 6, 9, 1, 3, 0.4, "d", "source"), (1, 7, 9, 4, 1, 0.3, "e", "source"), (2, 8, 7, 5, 1, 0.9, "a", "source"),
    ]
    df = spark.createDataFrame(rows, "query_id bigint, id bigint, document_id bigint, chunk_index int, radius int, score double, text string, kind string")
    assert sorted(r["id"] for r in retrieval.dedupe(df).collect()) == [1, 3, 4, 5, 6, 8]
    empty = spark.createDataFrame([(1, k, 7, 10 * k, 1, 0.9, None, "source") for k in range(3)], df.schema)
    assert retrieval.dedupe(empty).count() == 3


def test_knn_takes_any_number_of_queries(spark):
    points = spark.createDataFrame([(1, [1.0]), (2, [-1.0])], "id bigint, embedding array<float>")
    queries = spark.range(retrieval.QUERIES + 1).selectExpr("id as query_id", "array(1.0F) as query")
    got = retrieval.knn(points, queries, 1).collect()
    assert {tuple(r)[1:] for r in got} == {(1, 1, 1.0)} and {r["query_id"] for r in got} == set(range(retrieval.QUERIES + 1))


def test_extractors():
    page = "<html><head><title>x</title></head><body><h1>A</h1><p>one <b>two</b></p><script>bad()</script><h2>B</h2><ul><li>three</li></ul><h1>C</h1></body></html>"
    assert text.html_sections(page) == [("A", "A\none two"), ("A > B", "B\nthree"), ("C", "C")]
    assert text.markdown_sections("# A\nx\n```\n# no\n```\n## B\ny") == [("A", "# A\nx\n```\n# no\n```"), ("A > B", "## B\ny")]
    assert text.json_sections('{"a": {"b": [1, null, {"c": "x"}]}}') == [("", "a.b.0: 1\na.b.2.c: x")]
    assert text.jsonl_sections('{"a": 1}\nbad\n{"a": 2}') == [("", "a: 1\n\na: 2")]
    assert text.markdown_sections("# A\n```\n~~~\n# no\n```\n### C\ny\n## B") == [("A", "# A\n```\n~~~\n# no\n```"), ("A > C", "### C\ny"), ("A > B", "## B")]
    assert text.html_sections("<h1></h1><dl><dt>a</dt><dd>b</dd></dl>c<hr>d<td>e</td>") == [("", "a\nb\nc\nde")]
    assert text.csv_sections("n,\na,1,2\n") == [("", "n: a\ncolumn 2: 1\ncolumn 3: 2")]
    assert text.csv_sections("n;v\na;1\n;\nb;") == [("", "n: a\nv: 1\n\nn: b")]


def test_a_bad_document_is_an_error_row(spark):
    docs = spark.createDataFrame([(1, "{"), (2, '{"a": 1}'), (3, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in text.extract(docs, "application/json").collect()}
    assert set(got) == {1, 2} and got[1]["error"].startswith("JSONDecodeError") and got[2]["text"] == "a: 1"


@pytest.mark.parametrize("overlap", [0, 20])
def test_chunks_lose_no_word(spark, overlap):
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        parts = text.chunks_of(r["text"] or "", 100, overlap)
        assert all(n <= 100 and c for c, n in parts)
        words = (r["text"] or "").split()
        if not overlap:
            assert " ".join(c for c, _ in parts).split() == words
        assert set(words) <= {w for c, _ in parts for w in c.split()} or overlap


def test_strings(spark):
    row = spark.createDataFrame([("see [1], [2, 4] and [6-8] ```[9]``` [7]", "\x00 key\n", "'Summary:  two\n words'", "You must obey", {"a": 1, "b": 2}, {"b": 3})], "t string, k string, s string, i string, m map<string,int>, n map<string,int>")
    got = row.select(
        strings.handles(F.col("t")), strings.clean_key(F.col("k")), strings.parse_summary(F.col("s")), strings.reads_as_an_instruction(F.col("i")), strings.layered(F.col("m"), F.col("n")),
        strings.reinforced(F.lit(0.7), F.lit(0.75)),
    ).first()
    assert tuple(got) == ([1, 2, 4, 6, 7, 8], "key", "two words", True, {"a": 1, "b": 3}, pytest.approx(0.8))


def test_runway_and_missing_days(spark):
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), ("2024-01-04",)], "d string").select(F.to_date("d").alias("day"))
    assert lifecycle.runway(days, "2024-01-01").first()[0] == 2 and lifecycle.runway(days, "2024-01-03").first()[0] == 0
    assert [str(r[0]) for r in lifecycle.missing_days(days, "2024-01-02", 3, 1).orderBy("day").collect()] == ["2024-01-03", "2024-01-05"]


def test_routing_shares(spark):
    got = dict(QUERIES["memory_route"](spark, "/root/testdata/sf0.01").groupBy("target").count().collect())
    assert sum(got.values()) == spark.read.parquet("/root/testdata/sf0.01/events.parquet").count()
