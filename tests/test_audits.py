"""The vector audit and snapshot differences on small odd tables, against plain versions."""

import json
import random

from pyspark.sql import functions as F

from quillspark.operators import snapshots, vector_audit


def walk(prefix, a, b, out):
    missing = object()

    def go(p, x, y):
        if isinstance(x, dict) or isinstance(y, dict):
            left, right = (v if isinstance(v, dict) else {} for v in (x, y))
            for k in {**left, **right}:
                go(f"{p}.{k}" if p else k, left.get(k, missing), right.get(k, missing))
        elif x is missing or y is missing or type(x) is not type(y) or x != y:
            out.append((p, "added" if x is missing else "removed" if y is missing else "changed"))

    go(prefix, a, b)


def random_json(rng, depth):
    kind = rng.randrange(9 if depth else 7)
    if kind >= 6 and depth:
        return {rng.choice("abcde"): random_json(rng, depth - 1) for _ in range(rng.randrange(4))}
    return [0, 1.0, 1, None, True, "x", [1, "y"], False, "é\""][kind]


def test_snapshots_equal_the_plain_walk(spark):
    rng = random.Random(11)
    pairs = [(i, {"r": random_json(rng, 3), "s": random_json(rng, 2)}, {"r": random_json(rng, 3), "s": random_json(rng, 2)}) for i in range(120)]
    pairs += [(900, {"a": {"b": 1}}, {"a": 5}), (901, {"a": 0}, {"a": False}), (902, {"a": 1}, {"a": 1.0}), (903, {"a": None}, {}), (904, {}, {"a": {}}), (905, {"l": [{"x": 1}]}, {"l": [{"x": 2}]}), (906, {"a": 1}, {"a": 1})]
    frame = lambda k: spark.createDataFrame([(p[0], json.dumps(p[k])) for p in pairs], "id bigint, body string")
    got = sorted((r["id"], r["path"], r["change"]) for r in snapshots.diff(frame(1), frame(2)).collect())
    want = []
    for i, a, b in pairs:
        out = []
        walk("", a, b, out)
        want += [(i, p, c) for p, c in out if p]
    assert got == sorted(want)


def test_bounds_of_what_is_shown(spark):
    before = spark.createDataFrame([(1, json.dumps({f"k{i:03}": i for i in range(130)})), (2, '{"t": "' + "x" * 900 + '", "key": "old", "gone": "s"}'), (3, None), (4, "no json"), (5, "[1]")], "id bigint, body string")
    after = spark.createDataFrame([(1, "{}"), (2, '{"t": "' + "x" * 901 + '", "key": null}'), (3, '{"a": 1}')], "id bigint, body string")
    rows = {(r["id"], r["path"]): r for r in snapshots.diff(before, after, sensitive=("key", "gone")).collect()}
    assert sum(i == 1 for i, _ in rows) == snapshots.MOST_CHANGES and {r["omitted"] for (i, _), r in rows.items() if i == 1} == {30}
    assert rows[2, "t"]["truncated"] and len(rows[2, "t"]["before"]) == snapshots.MOST_CHARS
    assert (rows[2, "key"]["before"], rows[2, "key"]["after"]) == ('"[redacted]"', "null") and rows[2, "gone"]["before"] == '"[redacted]"'
    assert rows[3, "a"]["change"] == "added" and not any(i in (4, 5) for i, _ in rows)
    assert snapshots.diff(before.where("false"), after.where("false")).count() == 0


def test_vector_audit(spark):
    rows = [(i, i % 4, [1.0, float(i)], f"h{i}", "t") for i in range(1, 20)]
    rows += [(30, 1, [0.0, 0.0], "z", ""), (31, 2, None, "n", ""), (32, 2, [1.0], "w", ""), (33, 3, [5.0, 5.0], "c1", ""), (34, 3, [5.0, 5.0], "c2", ""), (35, 3, [7.0, 7.0], "s", ""), (36, 1, [7.0, 7.0], "s", ""), (37, 1, [], "e", "")]
    points = spark.createDataFrame(rows, "id bigint, document_id bigint, embedding array<double>, text_hash string, text string")
    none = spark.createDataFrame([], "document_id bigint, embedding_model string")
    got = {r["code"]: (r["severity"], r["count"], r["documents"]) for r in vector_audit.findings(points, 2, "m", none).collect()}
    # Copies of one text are no finding, and a vector without components is of another width and of no length.
    assert got == {"dimension_mismatch": ("red", 2, 2), "zero_vectors": ("red", 2, 1), "identical_vectors": ("red", 2, 1) if 2 / 26 >= 0.05 else ("amber", 2, 1), "norm_spread": ("amber", 24, None)}
    assert vector_audit.findings(points.where("false"), 2, "m", none).count() == 0
    near = spark.createDataFrame([(1, 2, 1, 0.99), (2, 5, 1, 0.5), (3, 7, 1, 0.999)], "query_id bigint, id bigint, rank int, score double")
    assert sorted(tuple(r) for r in vector_audit.twins(near, points).collect()) == [(1, 1, 2, 0.99)]
    got = {r["code"]: r["count"] for r in vector_audit.findings(points, 2, "m", none, near).collect()}
    assert got["low_agreement"] == 2 and got["near_duplicate_vectors"] == 1


def test_drift_of_a_fresh_sample(spark):
    points = spark.range(50).selectExpr("id", "id % 5 as document_id", "array(1.0D, double(id)) as embedding", "string(id) as text_hash", "string(id) as text")
    none = spark.createDataFrame([], "document_id bigint, embedding_model string")
    same = lambda t: t.selectExpr("id", "array(1.0D, double(id)) as embedding")
    turned = lambda t: t.selectExpr("id", "array(double(id), -1.0D) as embedding")
    samples = vector_audit.drift_samples(points, same, 20, "m")
    assert samples.count() == 20 and samples.where("cosine < 1").count() == 0
    assert vector_audit.findings(points, 2, "m", none, None, samples).where("code = 'drift'").count() == 0
    found = vector_audit.findings(points, 2, "m", none, None, vector_audit.drift_samples(points, turned, 20, "m")).where(F.col("code") == "drift").first()
    assert found["count"] == 20 and found["severity"] == "red"
