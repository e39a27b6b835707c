"""Replays and passes with state, and what goes through Python, against plain versions that share no code with them."""

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import quillspark.plans.all  # noqa: F401
from quillspark.functions import embedding
from quillspark.operators import catalog, lifecycle, memory, prompts, reconciliation, retrieval, text
from quillspark.plans import findings as plans
from quillspark.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_limiter_of_several_rules(spark):
    """Every decision is made anew from the full history of what was committed before."""
    got = {r["event_id"]: (r["allowed"], r["refused_by"]) for r in QUERIES["limiter_rules_replay"](spark, SF).collect()}
    events = sorted((e.asDict(recursive=True) for e in plans.rule_events(spark, SF).collect()), key=lambda e: (e["gateway_id"], e["at"], e["event_id"]))
    spent, held = defaultdict(list), defaultdict(dict)
    for e in events:
        rules, at = e["rules"], e["at"]
        if e["kind"] == "release":
            for r in rules:
                held[r["key"]].pop(e["holder"], None)
            continue
        if e["kind"] == "settle":
            for r in rules:
                slot = [x for x in spent[r["key"]] if x[0] // r["span"] == at // r["span"]]
                spent[r["key"]].append((at, max(r["cost"], -sum(c for _, c in slot))))
            continue
        refused = None
        for r in rules:
            if r["lease"]:
                used = sum(t > at - r["span"] for t in held[r["key"]].values())
            else:
                n, span = at // r["span"], r["span"]
                total = lambda k: sum(c for t, c in spent[r["key"]] if t // span == k)  # noqa: B023, E731
                used = total(n - 1) * (1 - (at - n * span) / span) + total(n)
            if used + r["cost"] > r["value"] and refused is None:
                refused = r["key"]
        assert got.pop(e["event_id"]) == (refused is None, refused)
        if refused is None:
            for r in rules:
                if r["lease"]:
                    held[r["key"]][e["holder"]] = at
                else:
                    spent[r["key"]].append((at, r["cost"]))
    assert not got


def test_memory_pass(spark):
    facts, new = plans.memory_inputs(spark, SF)
    got = {(r["end_user_id"], r["fact_id"], r["outcome"]): (r["of_fact"], r["confidence"]) for r in reconciliation.reconcile(facts, new, 0.95).collect()}
    known, by_user = {}, defaultdict(list)
    for r in facts.collect():
        known[r["fact_id"]] = {"user": r["end_user_id"], "v": np.array(r["embedding"]), "c": r["confidence"], "live": r["live"], "fresh": False}
    for r in new.collect():
        by_user[r["end_user_id"]].append(r)
    want = {}
    for user, rows in by_user.items():
        order = []
        for r in sorted(rows, key=lambda r: r["place"]):
            v = np.array(r["embedding"])
            sims = {f: float(v @ k["v"]) for f, k in known.items() if k["user"] == user and k["v"] is not None}
            hit = [f for f in order if sims.get(f, 0) >= 0.95 - 1e-12]
            old = sorted(((-s, f) for f, s in sims.items() if not known[f]["fresh"]))
            pick = hit[0] if hit else old[0][1] if old and -old[0][0] >= 0.95 - 1e-12 else None
            if pick is not None and known[pick]["live"]:
                k = known[pick]
                k["c"] = min(1.0, max(k["c"], k["c"] + (1 - k["c"]) / 3, r["confidence"]))
                want[user, r["candidate_id"], "deduped"] = (pick, pytest.approx(k["c"]))
                continue
            known[r["candidate_id"]] = {"user": user, "v": v, "c": r["confidence"], "live": True, "fresh": True}
            order.append(r["candidate_id"])
            want[user, r["candidate_id"], "inserted"] = (None, pytest.approx(r["confidence"]))
            for f in r["supersedes"]:
                if f in known and known[f]["user"] == user and known[f]["live"] and f != r["candidate_id"]:
                    known[f].update(live=False, v=None)
                    want[user, f, "superseded"] = (r["candidate_id"], pytest.approx(known[f]["c"]))
    assert set(got) == set(want)
    outcomes = {o for *_, o in got}
    assert {"deduped", "inserted"} <= outcomes
    for k, v in want.items():
        assert (None if got[k][0] is None or (isinstance(got[k][0], float) and math.isnan(got[k][0])) else got[k][0]) == v[0], k


def test_over_budget_by_walking(spark):
    """Dead facts go before live ones; the walk stops as soon as both bounds hold."""
    rows = [(u, 100 * u + k, 0.1 * (k % 10), k % 3 == 0 if u % 2 else k % 5 > 0) for u in range(6) for k in range(7 + u)]
    frame = spark.createDataFrame(rows, "end_user_id int, fact_id int, confidence double, dead boolean")
    frame = frame.selectExpr("*", "timestamp_ntz'2024-01-01' as last_seen_at", "case when dead then timestamp_ntz'2024-01-02' end as superseded_at", "cast(null as timestamp_ntz) as expires_at")
    for bound in (2, 4, 6):
        want = set()
        for u in range(6):
            mine = sorted((not r[3], round(r[2] * 0.5 ** (31 / 90), 9), r[1]) for r in rows if r[0] == u)
            live, total = sum(m[0] for m in mine), len(mine)
            for alive, _, fact in mine:
                if live <= bound and total <= 2 * bound:
                    break
                if alive and live <= bound:
                    continue
                want.add(fact)
                total -= 1
                live -= alive
        got = {r["fact_id"] for r in memory.over_budget(frame, F.lit("2024-02-01").cast("timestamp_ntz"), bound).collect()}
        assert got == want, bound


def test_reconcile_keeps_what_is_in_work(spark):
    listing = spark.createDataFrame([("a", None), ("b", "1"), ("c", "1"), ("d", "1")], "key string, etag string")
    known = spark.createDataFrame([("a", None, "indexed"), ("b", "2", "skipped"), ("c", "2", "parsing"), ("x", "1", "parsing"), ("y", "1", "skipped"), ("z", "1", None)], "key string, etag string, status string")
    got = {r["key"]: r["action"] for r in lifecycle.reconcile(listing, known).collect()}
    assert got == {"a": "unchanged", "b": "updated", "c": "skipped", "d": "added", "x": "kept", "y": "deleted", "z": "kept"}


def test_embedded_texts(spark):
    got = {r["id"]: r["embedding"] for r in QUERIES["text_embedded"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d, t in docs[:40]:
        want = [0.0] * 256
        for w in re.findall(r"\w+", (t or "").lower()):
            h = hashlib.blake2b(w.encode(), digest_size=8).hexdigest()
            want[int(h[:8], 16) % 256] += 1 if int(h[8:10], 16) % 2 else -1
        n = math.sqrt(sum(x * x for x in want))
        assert got[d] == pytest.approx([x / n for x in want] if n else [1.0] + [0.0] * 255)
    assert list(embedding.vector(None, 4)) == [1, 0, 0, 0] and list(embedding.vector("…!", 4)) == [1, 0, 0, 0]


def test_search_finds_a_text_by_itself(spark):
    points = embedding.embed(spark.createDataFrame([(1, "red apples and pears"), (2, "the cat sat"), (3, None)], "id bigint, text string"))
    asked = embedding.embed(spark.createDataFrame([(9, "Red APPLES, and pears!")], "id bigint, text string")).selectExpr("id as query_id", "embedding as query")
    assert [tuple(r) for r in retrieval.knn(points, asked, 1).collect()] == [(9, 1, 1, 1.0)]


def test_citations(spark):
    texts = [
        ("See [2] and [1, 3].", [2, 1, 3], []), ("[1][2] m[1][2] a[3] word[^3]", [1, 2, 3], []), ("x [2-4] y [4-2] [1-99]", [2, 3, 4, 1], [99]),
        ("```\n[1]\n```\n[2]", [2], []), ("~~~\n[1]\n```\n[2]", [2], []), ("[0] [7] [1234] [1–2]", [1, 2], [0, 7]), (None, [], []), ("", [], []), ("[9] [9]", [], [9]),
    ]
    frame = spark.createDataFrame([(k, t, 4) for k, (t, _, _) in enumerate(texts)], "id bigint, text string, injected int")
    got = {r["id"]: r for r in prompts.resolved(frame).collect()}
    for k, (t, cited, unresolved) in enumerate(texts):
        assert (got[k]["cited"], got[k]["unresolved"]) == (cited, unresolved), t
        assert all(t[s["start"]] == "[" and t[s["end"] - 1] == "]" for s in got[k]["spans"])


def test_pages(spark):
    rows = spark.range(10)
    assert [tuple(r) for r in catalog.page(rows, "id", 3).orderBy("id").collect()] == [(7, 7), (8, 7), (9, 7)]
    assert [tuple(r) for r in catalog.page(rows, "id", 3, after=2).orderBy("id").collect()] == [(0, None), (1, None)]
    assert [r["id"] for r in catalog.page(rows, "id", 10, after=-1, newest_first=False).collect()] == list(range(10))
    assert catalog.page(rows, "id", 3, after=0).count() == 0


def test_chunks_by_heading_stay_in_their_section():
    body = "# A\n" + "one two three. " * 40 + "\n## B\n" + "four five. " * 10
    chunks = [c for _, s in text.markdown_sections(body) for c, _ in text.chunks_of(s, 30)]
    assert all(not ("one" in c and "four" in c) for c in chunks) and len(chunks) > 4
