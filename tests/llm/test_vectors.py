"""Top-k search and hard negatives against all pairs, over odd rows and with small blocks, groups and many pivots."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import hard_negatives, topk_search
from quillspark.llm import queries as llm
from quillspark.llm import vectors as V

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<double>, label int"
CLASH = "key id kind dim cells norm2 asked c r g s j n low high pivot label_ rank score band anchor".split()


def whole(v):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(256 * x) for x in v]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def by_score(rows):
    return sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))


def top_k(rows, k, every):
    rows = [(i, whole(v)) for i, v, _ in rows]
    rows = [r for r in rows if r[1] is not None]
    out = []
    for i, q in rows:
        if i is not None and i % every == 0:
            best = by_score([(dot(q, v), j) for j, v in rows if j is None or j != i])[:k]
            out += [(i, n + 1, j, s) for n, (s, j) in enumerate(best)]
    return sorted(out, key=repr)


def negatives(rows, every):
    rows = [(i, whole(v), (lab + 1) % 10 if i is not None and i % 7 == 0 else lab) for i, v, lab in rows if lab is not None]
    rows = [r for r in rows if r[1] is not None]
    out = []
    for i, a, lab in rows:
        if i is not None and i % every == 0:
            scored = [(dot(a, v), j, x) for j, v, x in rows if j is None or j != i]
            for p, pid in by_score([(s, j) for s, j, x in scored if x == lab])[:5]:
                band = by_score([(s, j) for s, j, x in scored if x != lab and 30 * p <= 100 * s <= 90 * p])[:10]
                out += [(i, pid, n + 1, j, p, s) for n, (s, j) in enumerate(band)]
    return sorted(out, key=repr)


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def moved():
    return F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")


TOP = ("query_id", "rank", "vec_id", "score")
HARD = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def random_rows(n, dim=6, seed=3, copies=0.3, labels=3):
    rng = np.random.default_rng(seed)
    hot = rng.normal(size=dim).tolist()
    return [(i, hot if rng.random() < copies else (rng.normal(size=dim) * rng.choice([0.2, 1.0, 3.0])).tolist(), int(rng.integers(labels))) for i in range(n)]


ODD = [
    *random_rows(60),
    (60, None, 1), (61, [], 1), (62, [0.5, None, 1.0, 0.0, 0.0, 0.0], 1), (63, [math.nan] * 6, 1), (64, [math.inf] + [0.0] * 5, 0),
    (None, [1.0] * 6, 1), (None, [1.0] * 6, 1), (65, [1.0, 1.0], 0), (66, [2.0] * 9, 2), (67, [1.0] * 6, None),
    (20, [0.3] * 6, 0), (20, [0.3] * 6, 0), (68, [-0.5] * 6, 0), (69, [0.0] * 6, 1), (-10, [0.7] * 6, 2),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).withColumns({c: F.lit("clash") for c in CLASH})


def test_top_k_of_odd_rows(odd):
    for k, block, group in ((5, V.BLOCK, V.GROUP), (5, 17, 4), (100, 40, 9)):
        found = topk_search.search(odd, F.expr("vec_id % 10 = 0"), k=k, block=block, group=group)
        assert got(found, *TOP) == top_k(ODD, k, 10)


def test_hard_negatives_of_odd_rows(odd, monkeypatch):
    want = negatives(ODD, 5)
    assert want
    for block, group, least in ((V.BLOCK, V.GROUP, 64), (30, 4, 4)):
        monkeypatch.setattr(hard_negatives, "ANCHORS_A_PIVOT", least)
        found = hard_negatives.mine(odd, moved(), F.expr("vec_id % 5 = 0"), block=block, group=group)
        assert got(found, *HARD) == want


def test_bounds_keep_what_is_near(spark, monkeypatch):
    """Well-parted vectors, so that the bounds leave most candidates out."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 5)) * 2
    rows = [(i, (centres[i % 12] + rng.normal(size=5) * 0.05).tolist(), i % 4) for i in range(600)]
    sent = []
    plain = hard_negatives._sent
    monkeypatch.setattr(hard_negatives, "_sent", lambda blocks, *a: sent.append(plain(blocks, *a)) or sent[-1])
    monkeypatch.setattr(hard_negatives, "ANCHORS_A_PIVOT", 8)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(hard_negatives.mine(df, moved(), F.expr("vec_id % 5 = 0")), *HARD) == negatives(rows, 5)
    # 15 pivots: without bounds each row would go to the 14 others.
    assert sent and sent[0].agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] < 600 * 14 * 0.6


def test_very_large_components(spark):
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate([[1e4] * 3, [-1e4] * 3, [3e7, 1.0, 2.0], [3e7, 1.0, 2.0001], [0.1] * 3, [1e150, 1.0, 1.0], [1e306, 0.0, 0.0]])]
    df = spark.createDataFrame(rows, SCHEMA)
    # 256 times the last one's component is no double, so it takes no part; scores beyond MOST count as MOST.
    cut = lambda x: max(-V.MOST, min(V.MOST, x))
    for i, q in enumerate(whole(r[1]) for r in rows[:6]):
        best = by_score([(cut(dot(q, whole(v))), j) for j, v, _ in rows[:6] if j != i])
        found = topk_search.search(df, F.col("vec_id") == i, k=5)
        assert got(found, "rank", "vec_id", "score") == [(n + 1, j, s) for n, (s, j) in enumerate(best)]
    assert hard_negatives.mine(df, F.col("label"), F.col("vec_id") == 0).count() == 0


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert topk_search.search(none, F.expr("vec_id % 50 = 0")).collect() == []
    assert hard_negatives.mine(none, moved(), F.expr("vec_id % 100 = 0")).collect() == []
    one = spark.createDataFrame([(0, [1.0], 1)], SCHEMA)
    assert topk_search.search(one, F.expr("vec_id % 50 = 0")).collect() == []
    assert hard_negatives.mine(one, moved(), F.expr("vec_id % 100 = 0")).collect() == []
    assert topk_search.search(one, F.lit(False)).collect() == []


def test_queries_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got(llm.op12_topk_search(spark, SF), *TOP) == top_k(rows, 5, 50)
    assert got(llm.op11_hard_negatives(spark, SF), *HARD) == negatives(rows, 100)


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for size in (100, 1 << 20, 1 << 28, 1 << 40):
        a, b = (rng.integers(-size, size, (7, 5)).astype(float) for _ in range(2))
        want = [[max(-V.MOST, min(V.MOST, dot(map(int, x), map(int, y)))) for y in b] for x in a]
        assert V.products(a, b).tolist() == want
