"""Streams with state: equal to the batch replay, to brute force, and unchanged by a restart in mid-batch."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

import quillspark.plans.all  # noqa: F401
from quillspark.operators import quotas
from quillspark.plans import streams
from quillspark.plans.findings import rule_events
from quillspark.streaming import distiller, frames, replayed, rules

SF = "/root/testdata/sf0.001"


def test_limiter_equals_the_batch_replay(spark):
    got = {tuple(r) for r in streams.limiter_rules_stream(spark, SF).collect()}
    want = {tuple(r) for r in quotas.replay(rule_events(spark, SF)).collect()}
    assert got == want and any(not r[1] for r in got) and any(r[1] for r in got)


def test_late_events_and_expired_leases(spark):
    slot = [("slots", True, 1.0, 60, 1.0)]
    rows = [
        (1, 7, 100, "consume", "a", slot), (2, 7, 130, "consume", "b", slot), (3, 7, 161, "consume", "c", slot),  # the lease of 1 has run out by itself
        (4, 7, 165, "release", "c", slot), (5, 7, 166, "consume", "d", slot), (6, 8, 150, "consume", "e", []),
        (7, 7, 4000, "consume", "f", slot), (8, 7, 170, "consume", "late", slot), (9, 9, 9000, "settle", "", []),
    ]
    schema = f"event_id bigint, gateway_id bigint, s bigint, kind string, holder string, rules {quotas.RULE}"
    events = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    arrival = F.timestamp_seconds(F.when(F.col("event_id") == 8, 8000).when(F.col("event_id") < 7, 10).otherwise(F.col("event_id") * 500))
    # Event 8 comes when the watermark stands at 3990: it has no decision and takes no slot.
    got = {tuple(r) for r in replayed.replayed(events, lambda s: rules.limited(s, "10 seconds"), arrival, 20).collect()}
    assert got == {(1, True, None), (2, False, "slots"), (3, True, None), (5, True, None), (6, True, None), (7, True, None)}


def test_frames(spark):
    rng = random.Random(5)
    sent, want = [], {}
    for request in range(40):
        parts = [rng.choice(["ab", "", "é𝔘", None, "x" * 9]) for _ in range(rng.randrange(1, 12))]
        missing = rng.randrange(len(parts)) if request % 4 == 1 else None
        for i, p in enumerate(parts):
            for _ in range(1 + (request % 5 == 2)):  # repeated frames
                if i != missing:
                    sent.append((request, 1000 + request + i, i, p, i == len(parts) - 1, 7 if i == len(parts) - 1 else None))
        kept = parts if missing is None else parts[:missing]
        text = "".join(p or "" for p in kept)
        want[request] = (text[:30], len(kept), len(text) > 30, missing is None, None if missing == len(parts) - 1 else 7)
    sent = [s for s in sent if s[0] in want]
    want = {r: w for r, w in want.items() if any(s[0] == r for s in sent)}
    sent.append((-1, 90_000, 0, "", True, None))
    df = spark.createDataFrame(sent, "request_id bigint, s bigint, seq bigint, content string, last boolean, usage bigint").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    arrival = F.timestamp_seconds(F.when(F.col("request_id") < 0, 90_000).otherwise(F.pmod(F.xxhash64("request_id", "seq"), F.lit(500))))
    got = replayed.replayed(df, lambda s: frames.completions(s, 30, 60, delay="200 seconds"), arrival, 6).where("request_id >= 0").collect()
    assert {r["request_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_a_full_buffer_closes_the_completion(spark):
    df = spark.createDataFrame([(1, k, f"{k},", k == 9, 10 + k) for k in range(10) if k != 2], "request_id bigint, seq bigint, content string, last boolean, s bigint")
    df = df.selectExpr("request_id", "timestamp_seconds(s) as ts", "seq", "content", "last", "cast(null as bigint) as usage")
    got = replayed.replayed(df, lambda s: frames.completions(s, 100, 60, buffered=3), F.col("ts"), 1).collect()
    assert [tuple(r) for r in got] == [(1, "0,1,", 2, False, False, None)]


def _passes(spark):
    rows = [(u, f"s{u % 3}", 1_000_000 * (1 + u // 4) + u, [(u * 10 + i, i, "long enough text of a user" if u % 5 else None) for i in range(1 + u % 3)]) for u in range(24)]
    return spark.createDataFrame(rows, distiller.PASS)


def test_a_restart_in_mid_batch_changes_nothing(spark, tmp_path):
    extract = lambda done: done.select("end_user_id", F.explode("log_ids").alias("source_log_id"))
    schema = "end_user_id bigint, source_log_id bigint"
    for k in range(3):
        _passes(spark).where(F.col("end_user_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(distiller.PASS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def rows(path):
        return sorted(tuple(r) for r in distiller.facts(spark, path, schema).drop("batch").collect()), sorted((r["end_user_id"], r["due_ms"], r["outcome"]) for r in distiller.marks(spark, path).collect())

    assert rows(f"{tmp_path}/none") == ([], [])
    distiller.distil(stream(), f"{tmp_path}/a", f"{tmp_path}/ca", extract, 20, 2).awaitTermination()
    whole = rows(f"{tmp_path}/a")
    assert len(whole[1]) == 24 and {r[2] for r in whole[1]} == {distiller.TOO_SHORT, distiller.DISTILLED} and len(set(whole[0])) == len(whole[0]) > 0

    calls = []

    def failing(done):
        calls.append(1)
        if len(calls) == 2:  # the second batch breaks when its facts are half written
            return extract(done).withColumn("end_user_id", F.expr("case when source_log_id % 2 = 0 then raise_error('lost') else end_user_id end").cast("bigint"))
        return extract(done)

    with pytest.raises(Exception, match="lost"):
        distiller.distil(stream(), f"{tmp_path}/b", f"{tmp_path}/cb", failing, 20, 2).awaitTermination()
    assert len(rows(f"{tmp_path}/b")[1]) == 8  # a reader sees the whole batch only
    distiller.distil(stream(), f"{tmp_path}/b", f"{tmp_path}/cb", failing, 20, 2).awaitTermination()
    assert rows(f"{tmp_path}/b") == whole


def test_the_daily_cap_counts_earlier_batches(spark):
    found = spark.createDataFrame([(1, f"s{k}", 1000 + k, [(k, k, "text " * 9)]) for k in range(4)] + [(2, "s", 5, [(9, 9, "")])], distiller.PASS)
    earlier = spark.createDataFrame([(1, 10, "succeeded"), (1, 11, "too_short"), (1, 86_400_000, "succeeded"), (2, 3, "over_cap")], "end_user_id bigint, due_ms bigint, outcome string")
    got = {(r["end_user_id"], r["session_id"]): r["outcome"] for r in distiller.judged(found, earlier, 20, 3).collect()}
    assert got == {(1, "s0"): "succeeded", (1, "s1"): "succeeded", (1, "s2"): "over_cap", (1, "s3"): "over_cap", (2, "s"): "too_short"}


class Store:
    """A state in memory that counts the calls on it."""

    calls = 0

    def __init__(self):
        self.held = {}

    def __getattr__(self, name):
        def call(*args):
            Store.calls += 1
            if name in ("put", "update"):
                self.held[None] = list(args[0])
            elif name == "appendList":
                self.held.setdefault(None, []).extend(args[0])
            elif name == "updateValue":
                self.held[args[0]] = args[1]
            elif name == "removeKey":
                self.held.pop(args[0], None)
            elif name == "clear":
                self.held.clear()
            told = {"exists": lambda: None in self.held, "get": lambda: self.held.get(None), "iterator": lambda: iter(list(self.held.items())), "containsKey": lambda k: k in self.held, "getValue": self.held.get}
            return told[name](*args) if name in told else None

        return call


class Handle:
    timers: list = []

    def getListState(self, *a):
        return Store()

    getMapState = getValueState = getListState

    def registerTimer(self, ms):
        self.timers.append(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_calls_on_state_do_not_grow_with_keys_and_events(monkeypatch):
    rng = random.Random(6)
    rows = [(i, float(rng.randrange(4000)), rng.choice(["consume"] * 3 + ["settle", "release"]), str(i // 3), json.dumps([{"key": f"u{i % 900}", "lease": i % 900 % 4 == 0, "value": 3.0, "span": 500, "cost": 1.0}, {"key": "g", "lease": False, "value": 700.0, "span": 900, "cost": 1.0}])) for i in range(9000)]
    limiter, got = rules.RuleLimiter(), []
    monkeypatch.setattr(Handle, "timers", [])
    monkeypatch.setattr(Store, "calls", 0)
    monkeypatch.setattr(rules, "PACK", 1000, raising=False)
    limiter.init(Handle())
    for part, now in ((rows[:5000], None), (rows[5000:], 1_500_000), ([], 3_000_400), ([], 10_000_000)):
        if part:
            list(limiter.handleInputRows(None, iter([pd.DataFrame(part, columns=["event_id", "at", "kind", "holder", "rules"])]), None))
        if now:
            Handle.timers.pop()
            got += [tuple(r) for f in limiter.handleExpiredTimer(None, Watermark(now), None) for r in f.itertuples(index=False)]
    store, want = quotas.Counters(), []
    for e, at, kind, holder, text in sorted(rows, key=lambda r: (r[1], r[0])):
        some = json.loads(text)
        if kind == "consume":
            refused = store.consume(some, at, holder)
            want.append((e, refused is None, refused))
        elif kind == "settle":
            store.settle(some, at)
        else:
            store.release(some, holder)
    assert got == want and any(not r[1] for r in want) and not limiter.rules.held and not limiter.waiting.held
    assert Store.calls < 4 * (rules.SHARES + 12)
