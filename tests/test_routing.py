"""Attempts, encodings, alerts and previews on small odd tables."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import tokens
from quillspark.operators import preview, routing


def test_attempts(spark):
    requests = spark.createDataFrame([(1, 1, 7), (2, 2, 7), (3, 3, 7), (4, 4, 7), (5, 5, None), (6, 9, 1)], "id bigint, gateway_id bigint, end_user_id bigint")
    gateways = spark.createDataFrame([(1, "failover"), (2, "single"), (3, None), (4, "ab_split"), (5, "failover")], "gateway_id bigint, mode string")
    targets = spark.createDataFrame([(g, t, p, 1) for g in (1, 2, 3, 4) for t, p in (("x", 2), ("y", 1), ("z", 2))], "gateway_id bigint, target string, priority int, weight int")
    got = sorted(map(tuple, routing.attempts(requests, gateways, targets).collect()))
    assert [r for r in got if r[0] != 4] == [(1, 1, "y", True), (1, 2, "x", True), (1, 3, "z", True), (2, 1, "y", False), (3, 1, "y", False)]
    assert [r[1::2] for r in got if r[0] == 4] == [(1, False)]


def test_estimates_and_sums(spark):
    limits = spark.createDataFrame([(1, 10, None, None), (2, None, 10, 5), (3, None, 10, None), (4, None, None, 5)], "id int, gateway_tokens int, user_tokens int, end_user_id int")
    assert [r[0] for r in limits.where(routing.needs_estimate(limits)).orderBy("id").collect()] == [1, 2]
    messages = spark.createDataFrame([(1, "a, b"), (1, None), (2, None), (2, "")], "id int, content string")
    assert sorted(map(tuple, routing.prompt_tokens(messages, "id").collect())) == [(1, 3), (2, 0)]


def test_decoding(spark):
    texts = ["", "plain", "é日𝔘", "﻿double"]
    rows = [(f"{i}-{e}", mark + t.encode(e), t) for i, t in enumerate(texts) for e, mark in (("utf-8", b"" if t[:1] != "﻿" else b"\xef\xbb\xbf"), ("utf-8", b"\xef\xbb\xbf"), ("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"))]
    rows += [("bad", b"\xc3\x28", None), ("cut", "é".encode()[:1], None), ("none", None, None)]
    df = spark.createDataFrame([(k, bytearray(b) if b is not None else None, t) for k, b, t in rows], "k string, data binary, want string")
    assert df.where(~routing.decoded(F.col("data")).eqNullSafe(F.col("want"))).count() == 0


def test_alerts(spark):
    audits = spark.createDataFrame(
        [(1, 1, "v", 5, "succeeded", "red"), (2, 1, "v", 5, "succeeded", "red"), (3, 1, "c", 1, "succeeded", "red"), (4, 1, "c", 2, "succeeded", "amber"), (5, 2, "v", 1, "failed", "red"), (6, 3, "v", 1, "succeeded", "red")],
        "audit_id int, connector_id int, kind string, created_at int, status string, severity string",
    )
    names = spark.createDataFrame([(1, "one"), (2, "two")], "connector_id int, name string")
    assert [tuple(r) for r in routing.audit_alerts(audits, names).collect()] == [(1, "one", "v", 2)]


def test_preview(spark):
    docs = spark.createDataFrame([(1, "One two three. Four five six. " * 8), (2, None), (3, ""), (4, "a b")], "doc_id bigint, text string")
    some = (preview.Candidate("a", 10, 2), preview.Candidate("b", 5, 0, False))
    cut = preview.chunks(docs, some)
    want = {(c.name, d, p) for d, t in ((1, "One two three. Four five six. " * 8), (4, "a b")) for c in some for _, p in tokens.windows(t, c.size, c.overlap, c.snap)}
    assert {(r["candidate"], r["doc_id"], r["text"]) for r in cut.collect()} == want
    got = {r["candidate"]: r for r in preview.compared(cut, some).collect()}
    assert got["a"]["documents"] == 2 and got["b"]["tokens"] == 66 and got["b"]["high"] == 5 and got["a"]["tokens"] > 66
    empty = preview.compared(preview.chunks(docs.where("false"), some), some).collect()
    assert {(r["chunks"], r["documents"], r["tokens"]) for r in empty} == {(0, 0, 0)}
    for bad in ((), (some[0], some[0]), some * 3):
        with pytest.raises(ValueError):
            preview.chunks(docs, bad)


def test_preview_counts_boundaries_within_sentences_and_repeated_tokens(spark):
    texts = {1: "One two three. Four five six. " * 8, 2: "no end here at all " * 9, 3: 'He said "no." Then (so it went.) And\u00a0', 4: "", 5: "Ab  cd. " * 30 + "tail", 6: "x" * 50}
    docs = spark.createDataFrame([*texts.items(), (7, None)], "doc_id bigint, text string").repartition(3)
    some = (preview.Candidate("a", 10, 2), preview.Candidate("b", 5, 0, False), preview.Candidate("c", 4, 3), preview.Candidate("d", 3))
    got = {r["candidate"]: r for r in preview.compared(preview.chunks(docs, some), some).collect()}
    for c in some:
        mid = repeated = 0
        for t in texts.values():
            cut = [p for _, p in tokens.windows(t, c.size, c.overlap, c.snap)]
            mid += sum(not p.endswith(tuple(".!?\"')]")) for p in cut[:-1])
            # What every token of the text is read for beyond once.
            repeated += sum(tokens.count(tokens.WORDS, p) for p in cut) - tokens.count(tokens.WORDS, t)
        assert (got[c.name]["mid_sentence"], got[c.name]["repeated"]) == (mid, repeated)
    assert got["b"]["mid_sentence"] > 0 and got["b"]["repeated"] == 0 and got["c"]["repeated"] > got["a"]["repeated"] > 0
