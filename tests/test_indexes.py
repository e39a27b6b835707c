"""Index versions: resumed copies, checks, flips and races; and greedy batches against the plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import strings
from quillspark.operators import batches, rebuild

SCHEMA = "id bigint, connector_id bigint, embedding array<double>"


@pytest.fixture
def points(spark):
    rows = [(i, i % 3 if i % 7 else None, [float(i), 1.0, 2.0]) for i in range(60)]
    return spark.createDataFrame([*rows, (None, 1, [0.0, 0.0, 0.0])], SCHEMA)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_rebuild_resumes_checks_and_flips(spark, points, tmp_path):
    index = rebuild.Index(spark, str(tmp_path / "index"), SCHEMA, 4)
    assert index.read().count() == 0 and index.live_version() is None and index.versions() == []
    assert index.copy(points, "v1", lambda p: p) == 60
    assert index.read().count() == 0  # nothing is read before it is promoted
    index.promote("v1", 60, 3)
    before = index.read()
    assert ids(before) == list(range(60))

    asked = []

    def embed(p):
        asked.append(ids(p))
        if len(asked) == 3:
            raise RuntimeError("the model is gone")
        return p.withColumn("embedding", F.expr("transform(embedding, x -> x + 1)"))

    with pytest.raises(RuntimeError, match="gone"):
        index.copy(index.read(), "v2", embed)
    with pytest.raises(rebuild.NotPromoted, match="too few"):
        index.promote("v2", 60, 3)
    assert ids(index.read()) == list(range(60)) and index.live_version() == "v1"
    # A share that is there in part, as after a loss of files, is completed and not doubled.
    done = sorted(asked[0] + asked[1])
    index._append(points.where(F.col("id").isin(asked[2][:2])), "v2", "part=2")
    assert index.copy(index.read(), "v2", embed) == 60
    assert sorted(x for a in asked[3:] for x in a) == sorted(set(range(60)) - set(done) - set(asked[2][:2]))
    with pytest.raises(rebuild.NotPromoted, match="other width"):
        index.promote("v2", 60, 4)
    index.promote("v2", 60, 3)
    assert index.live_version() == "v2" and ids(index.read()) == list(range(60))
    # What was read before the flip is still the old version, whole.
    assert before.where("embedding[1] = 1").count() == 60
    with pytest.raises(rebuild.NotPromoted, match="not written again"):
        index.copy(points, "v1", embed)


def test_recut_connectors_and_repeated_points(spark, points, tmp_path):
    index = rebuild.Index(spark, str(tmp_path / "index"), SCHEMA, 2)
    left = index.copy(points, "v1", lambda p: p, spark.createDataFrame([(1,), (1,)], "connector_id bigint"))
    assert left == points.where("id is not null and not coalesce(connector_id = 1, false)").count()
    new = points.where("connector_id = 1 and id is not null").withColumn("id", F.col("id") + 1000)
    for _ in range(2):
        added = index.add(new, "v1")
    index.promote("v1", left + added, 3)
    assert index.read().count() == 60
    index._append(points.where("id = 5"), "v2", "part=0")
    index._append(points.where("id = 5"), "v2", "part=1")
    with pytest.raises(rebuild.NotPromoted, match="repeated"):
        index.promote("v2", 2, 3)
    index.copy(points.where("false"), "v3", lambda p: p)
    index.promote("v3", 0, 3)
    assert index.read().count() == 0 and index.live_version() == "v3"


def test_one_of_two_promotions_wins(spark, points, tmp_path):
    index = rebuild.Index(spark, str(tmp_path / "index"), SCHEMA, 2)
    for v in ("a", "b", "c"):
        index.copy(points, v, lambda p: p)
    index.promote("a", 60, 3)
    index._flip("b", 2)
    with pytest.raises(rebuild.NotPromoted, match="number 2"):
        index._flip("c", 2)
    assert index.live_version() == "b"
    index._flip("c", 3)
    assert index.retire(keep=2) == ["a"] and index.versions() == ["b", "c"]


def test_scroll_and_deletion(points):
    page, seen = None, []
    while True:
        rows = rebuild.scroll(points, page, 25).collect()
        seen += [r["id"] for r in rows]
        if len(rows) < 25:
            break
        page = rows[-1]["id"]
    assert seen == list(range(60))
    assert rebuild.without_connector(points, 1).where("connector_id = 1").count() == 0
    assert rebuild.without_connector(points, 1).where("connector_id is null").count() == points.where("connector_id is null").count()


def loop(rows, most, budget):
    out, batch, held, used = {}, 0, 0, 0
    for i, _, c in sorted(rows, key=lambda r: (r[1], r[0])):
        c = c or 0
        if held and (held >= most or used + c > budget):
            batch, held, used = batch + 1, 0, 0
        out[i] = (batch, held)
        held, used = held + 1, used + c
    return out


@pytest.mark.parametrize("n,most,budget,block", [(700, 5, 40, 16), (700, 16, 1000, 16), (333, 1, 10, 7), (50, 8, 60, 8192), (1, 3, 1, 4), (512, 3, 9, 8)])
def test_batches_equal_the_loop(spark, n, most, budget, block):
    rng = random.Random(n + most)
    rows = [(i, rng.choice([i * 3, 7, 1_000_000 - i]), rng.choice([0, None, 3, 12, 35, 90])) for i in range(n)]
    df = spark.createDataFrame(rows, "id bigint, k bigint, cost bigint").repartition(3)
    got = {r["id"]: (r["batch"], r["place"]) for r in batches.greedy(df, most, budget, by="k", block=block).collect()}
    assert got == loop(rows, most, budget)


def test_no_batches(spark):
    assert batches.greedy(spark.createDataFrame([], "id bigint, cost bigint"), 3, 3).collect() == []
    with pytest.raises(ValueError):
        batches.greedy(spark.createDataFrame([], "id bigint, cost bigint"), 0, 3)


def test_a_bracket_of_very_many_numbers(spark):
    texts = ["[" + ", ".join(str(k % 9000) for k in range(100_000)) + "] [7]", "[1-3, 5] [12345] [a] [1,] [2 - 4]", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(strings.handles(F.col("t"))).collect()]
    assert got[0] == list(range(9000)) and got[1] == [1, 2, 3, 4, 5]
