"""Evaluation at every level, gateway-given redaction, and the nearest neighbours, on small odd tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import evaluation, retrieval, scrub

ITEM = "item_id bigint, verified boolean, retrieved array<struct<chunk_id:bigint,document_id:bigint,injected:boolean>>, relevant_chunks array<bigint>, relevant_documents array<bigint>"


def test_levels(spark):
    rows = [
        (1, True, [(10, 1, True), (11, None, False), (12, 2, True)], [11, 13], [2]),
        (2, False, [(10, 1, True)], [], [1]),  # labelled by document only
        (3, None, [], None, None),  # wants nothing and gets nothing
        (4, True, [(10, 1, None)], [], []),  # wants nothing, gets something that isn't injected
        (5, False, None, [9], [9]),
    ]
    scores = {(r["level"], r["item_id"]): (r["recall"], r["precision"], r["rr"], r["hit"]) for r in evaluation.level_scores(spark.createDataFrame(rows, ITEM), 2).collect()}
    none = (None,) * 4
    assert len(scores) == 20
    assert scores["chunk", 1] == (0.5, 0.5, 0.5, 1.0) and scores["chunk_injected", 1] == (0.0, 0.0, 0.0, 0.0)
    assert scores["document", 1] == (0.0, 0.0, 0.0, 0.0)  # document 2 stands beyond k
    assert scores["chunk", 2] == none and scores["document", 2] == (1.0, 1.0, 1.0, 1.0)
    assert scores["chunk", 3] == (None, 1.0, None, None) == scores["document_injected", 4] and scores["chunk", 4] == (None, 0.0, None, None)
    assert scores["chunk", 5] == (0.0, 0.0, 0.0, 0.0)
    run = {(r["population"], r["level"]): r for r in evaluation.run_levels(evaluation.level_scores(spark.createDataFrame(rows, ITEM), 2)).collect()}
    assert (run["all", "chunk"]["items"], run["all", "chunk"]["scored"], run["all", "chunk"]["negatives"], run["all", "chunk"]["clean_negatives"]) == (5, 2, 2, 1)
    assert run["verified", "chunk"]["items"] == 2 and run["all", "chunk"]["recall"] == 0.25
    levels = evaluation.run_levels(evaluation.level_scores(spark.createDataFrame(rows, ITEM), 2))
    assert {tuple(r)[2:] for r in evaluation.metric_deltas(levels, levels).where("population = 'all'").collect()} == {(0.0,) * 4}


def test_relevant_documents(spark):
    labels = spark.createDataFrame([(1, 5, 2), (1, 6, None), (2, 7, None)], "item_id bigint, chunk_id bigint, document_id bigint")
    named = spark.createDataFrame([(1, 2), (1, 1), (3, None)], "item_id bigint, document_id bigint")
    assert [tuple(r) for r in evaluation.relevant_documents(labels, named).collect()] == [(1, [1, 2])]


BODIES = [
    '{"a@b.cc": "mail a@b.cc now", "l": [1, {"x": ["secret-1", null, "q\\"secret-2\\\\"]}], "t": "é\\u0041\\nsecret-3"}', '"secret-4"', "plain secret-5 text", '{"broken": "secret-6"', "[]", "", None,
    '{"k" : {"secret-7": "v"}}', '["' + "\\\\" * 50_000 + ' secret-8"]',
]


def test_scrub(spark):
    bodies = spark.createDataFrame([(1, i, b) for i, b in enumerate(BODIES)] + [(2, 90, "secret-1"), (3, 91, "secret-1"), (None, 92, "secret-1"), (4, 93, "secret-1")], "gateway_id bigint, id int, body string")
    gateways = spark.createDataFrame([(1, [r"secret-\d", r"\w+@\w+\.\w+", "(s+)+$", None, " "]), (2, []), (3, None), (4, ["x"] * 65)], "gateway_id bigint, patterns array<string>")
    got = {r["id"]: (r["body"], r["complete"]) for r in scrub.scrubbed(bodies, gateways).collect()}
    mark = scrub.REPLACEMENT
    first = json.loads(got[0][0])
    assert first == {"a@b.cc": f"mail {mark} now", "l": [1, {"x": [mark, None, f'q"{mark}\\']}], "t": f"éA\n{mark}"}
    assert got[1] == (f'"{mark}"', True) and got[2] == (f"plain {mark} text", True) and got[3] == (f'{{"broken": "{mark}"', True)
    assert got[4] == ("[]", True) and got[5] == ("", True) and got[6] == (None, True)
    assert got[7] == ('{"k" : {"secret-7":"v"}}', True) or json.loads(got[7][0]) == {"k": {"secret-7": "v"}}
    assert json.loads(got[8][0]) == ["\\" * 50_000 + f" {mark}"]
    assert all(got[i] == ("secret-1", True) for i in (90, 91, 92)) and got[93] == (None, False)


@pytest.mark.parametrize("queries,points", [(2048, 16384), (3, 7)])
def test_nearest_neighbours(spark, monkeypatch, queries, points):
    monkeypatch.setattr(retrieval, "QUERIES", queries)
    monkeypatch.setattr(retrieval, "POINTS", points)
    rng = np.random.default_rng(4)
    hot = rng.normal(size=4).tolist()
    rows = [(i, hot if i % 3 == 0 else rng.normal(size=4).tolist()) for i in range(40)] + [(40, None), (41, [1.0, None, 0.0, 0.0]), (42, [0.0] * 4), (43, [1.0, 2.0]), (44, []), (3, hot)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    asked = df.where("id % 5 = 0 and id < 45").selectExpr("id as query_id", "embedding as query").dropDuplicates(["query_id"])

    def cosine(a, b):
        if a is None or b is None or None in a or None in b:
            return 0.0
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return float(np.round(sum(x * y for x, y in zip(a, b, strict=False)) / n, 6)) if n else 0.0

    for k, least, alone in ((5, -1.0, True), (100, 0.2, False)):
        want = []
        for q, v in {i: v for i, v in rows if i % 5 == 0}.items():
            best = sorted((-cosine(v, w), i) for i, w in rows if not (alone and i == q) and cosine(v, w) >= least)[:k]
            want += [(q, i, n + 1, -s) for n, (s, i) in enumerate(best)]
        got = sorted(map(tuple, retrieval.knn(df, asked, k, least, alone).collect()))
        assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and np.allclose([g[3] for g in got], [w[3] for w in sorted(want)], atol=2e-6)
    assert retrieval.knn(df.where("false"), asked, 3).count() == 0 == retrieval.knn(df, asked.where("false"), 3).count()
