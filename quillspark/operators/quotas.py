"""Rules of the limiter: which apply, what is left of them, and replays over several at once."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.shared import remove, shared_folder
from quillspark.streaming.limits import weighted

#: Windows of the limits in seconds; concurrency has none.
WINDOWS = {"rpm": 60, "rpd": 86400, "tpm": 60, "tpd": 86400, "concurrency": None}


def bucket_key(limit: Column, gateway_id: Column, end_user_id: Column | None = None) -> Column:
    parts = [gateway_id.cast("string"), *([] if end_user_id is None else [end_user_id.cast("string")]), limit]
    return F.concat_ws(":", F.lit("rl"), *parts)


def plan(requests: DataFrame, names: Sequence[str]) -> DataFrame:
    """The rules that apply to each request, in the order they are checked.

    requests: id, gateway_id, end_user_id and, for each name, gateway_<name> and user_<name>.  A null value is
    no rule, and without a user no user's rule applies.
    """
    rules = []
    for name in names:
        for scope in ("gateway", "end_user"):
            mine = scope == "end_user"
            value = F.col(f"{'user' if mine else 'gateway'}_{name}")
            key = bucket_key(F.lit(name), F.col("gateway_id"), F.col("end_user_id") if mine else None)
            rules.append(
                F.struct(
                    F.lit(len(rules)).alias("place"), F.lit(scope).alias("scope"), F.lit(name).alias("limit"), value.cast("bigint").alias("value"),
                    F.when(F.col("end_user_id").isNotNull() | F.lit(not mine), key).alias("key"), F.lit(WINDOWS[name]).cast("int").alias("window_seconds"),
                )
            )
    each = requests.select("id", F.explode(F.array(*rules)).alias("_rule")).select("id", "_rule.*")
    return each.where("value is not null and key is not null")


def tightest(readings: DataFrame) -> DataFrame:
    """The windowed reading of each request with the least share left, ties by the shorter window, then by the order of checking."""
    share = F.col("remaining") / F.col("value")
    best = readings.where("window_seconds is not null").groupBy("id").agg(F.min_by(F.struct("limit", "remaining", "value", "window_seconds"), F.struct(share, "window_seconds", "place")).alias("_best"))
    return best.select("id", "_best.*")


def retry_after(concurrency: Column, reset_seconds: Column) -> Column:
    return F.when(concurrency, 1).otherwise(F.greatest(F.lit(1), F.ceil(reset_seconds))).cast("int")


class Counters:
    """Counters of windows (two slots each) and leases of slots, of one gateway."""

    def __init__(self):
        self.counts: dict[str, dict[int, float]] = {}
        self.leases: dict[str, dict[str, float]] = {}

    def _used(self, rule, at: float) -> float:
        if rule["lease"]:
            held = {m: t for m, t in self.leases.get(rule["key"], {}).items() if t > at - rule["span"]}
            self.leases[rule["key"]] = held
            return len(held)
        slot = int(at // rule["span"])
        kept = {s: v for s, v in self.counts.get(rule["key"], {}).items() if s >= slot - 1}
        self.counts[rule["key"]] = kept
        return weighted(kept.get(slot - 1, 0.0), kept.get(slot, 0.0), at - slot * rule["span"], rule["span"])

    def _add(self, rule, at: float, amount: float) -> None:
        counts, slot = self.counts.setdefault(rule["key"], {}), int(at // rule["span"])
        counts[slot] = max(0.0, counts.get(slot, 0.0) + amount)

    def consume(self, rules, at: float, holder: str) -> str | None:
        """The first rule's key that refuses; None commits all of them."""
        for rule in rules:
            if self._used(rule, at) + rule["cost"] > rule["value"]:
                return rule["key"]
        for rule in rules:
            if rule["lease"]:
                self.leases.setdefault(rule["key"], {})[holder] = at
            else:
                self._add(rule, at, rule["cost"])
        return None

    def settle(self, rules, at: float) -> None:
        for rule in rules:
            if not rule["lease"]:
                self._add(rule, at, rule["cost"])

    def release(self, rules, holder: str) -> None:
        for rule in rules:
            self.leases.get(rule["key"], {}).pop(holder, None)


RULE = "array<struct<key:string,lease:boolean,value:double,span:int,cost:double>>"

#: About as many events of a gateway as one task sorts and replays at a time.
SLICE = 1 << 19
DECIDED = "event_id bigint, allowed boolean, refused_by string, gateway_id string, key string, state string"


def _values(column: pa.Array) -> list:
    """`to_pylist`, by way of numpy where that says the same."""
    return column.to_pylist() if column.null_count and not pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False).tolist()


def _decided(events: DataFrame) -> DataFrame:
    """Decisions of `consume` events, and the counters of gateways that go on: rows of gateway_id, key, state without a decision.

    events: those of `replay`, goes_on, and rows of kind `kept`, whose holder is a key and whose state is what it came to; they have no time, so they come first.
    """
    names, types = zip(*(c.split() for c in DECIDED.split(", ")))
    schema = pa.schema(list(zip(names, [{"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[t] for t in types])))

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def kept(gateway, store, ends, at) -> pa.RecordBatch:
        """Two windows on, or when the last lease has run out, nothing of a key counts any more."""
        rows = []
        for key, until in ends.items():
            if until > at:
                state = {"counts": list(store.counts.get(key, {}).items()), "leases": list(store.leases.get(key, {}).items()), "until": until}
                rows.append((None, None, None, gateway, key, json.dumps(state)))
        return made(rows)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gateway, store, ends, last, on = object(), Counters(), {}, 0.0, False
        for batch in it:
            rows, listed = [], batch.column("rules")
            fields = (_values(listed.values.field(f)) for f in ("key", "lease", "value", "span", "cost"))
            each = [{"key": k, "lease": lease, "value": v, "span": s, "cost": c} for k, lease, v, s, c in zip(*fields)]
            places = _values(listed.offsets)
            others = (_values(batch.column(c)) for c in ("event_id", "gateway_id", "at", "kind", "holder", "state", "goes_on"))
            for e, g, at, kind, holder, state, goes_on, a, b in zip(*others, places, places[1:]):
                if g != gateway:
                    if on:
                        yield kept(gateway, store, ends, last)
                    gateway, store, ends = g, Counters(), {}
                on = goes_on
                if kind == "kept":
                    state = json.loads(state)
                    store.counts[holder] = {int(s): v for s, v in state["counts"]}
                    store.leases[holder] = dict(state["leases"])
                    ends[holder] = state["until"]
                    continue
                rules = each[a:b]
                if on:
                    last = at
                    for rule in rules:
                        ends[rule["key"]] = max(ends.get(rule["key"], at), at + 2 * rule["span"])
                if kind == "consume":
                    refused = store.consume(rules, at, holder)
                    rows.append((e, refused is None, refused, None, None, None))
                elif kind == "settle":
                    store.settle(rules, at)
                else:
                    store.release(rules, holder)
            yield made(rows)
        if on:
            yield kept(gateway, store, ends, last)

    cols = events.select("event_id", "gateway_id", "at", "kind", "holder", "rules", "state", "goes_on")
    return cols.repartition("gateway_id").sortWithinPartitions("gateway_id", "at", "event_id").mapInArrow(run, DECIDED)


def _dealt(events: DataFrame, slices: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """The events by `slice`, a range of (gateway_id, at, event_id); and the slices of each gateway: its `turn`, and whether it goes on."""
    spark = events.sparkSession
    ranges = events.repartitionByRange(slices, "gateway_id", "at", "event_id").withColumn("slice", F.spark_partition_id())
    ranges.write.partitionBy("slice").parquet(f"{folder}/events")
    dealt = spark.read.schema(ranges.schema).parquet(f"{folder}/events")
    mine = Window.partitionBy("gateway_id").orderBy("slice")
    turns = dealt.select("gateway_id", "slice").distinct().select(
        F.col("gateway_id").alias("_gateway"), F.col("slice").alias("_slice"), (F.row_number().over(mine) - 1).alias("turn"), F.lead("slice").over(mine).isNotNull().alias("goes_on")
    )
    turns.write.parquet(f"{folder}/turns")
    return dealt, spark.read.schema(turns.schema).parquet(f"{folder}/turns")


def replay(events: DataFrame) -> DataFrame:
    """event_id, allowed, refused_by of every `consume`, in order of time within a gateway.

    events: event_id, gateway_id, at (seconds), kind (consume, settle, release), holder, rules (an array of
    key, lease, value, span, cost).  All rules of an event commit or none does; `settle` corrects counters by
    its costs, never below 0; `release` gives leases back, and what was not given back runs out by itself.
    One gateway's events depend on each other, so a gateway is one task at a time, sorted, with two slots a key kept; an
    event older than one before it (by time, then id) can't occur in that order.

    A gateway of more than SLICE events is replayed slice after slice: the counters that still count are written to
    the shared folder and read by the next slice's task, so that none sorts or holds the whole gateway.  Turns run through
    all gateways at once, one job each; a null gateway is one like others.
    """
    cols = events.select(
        "event_id", F.col("gateway_id").cast("string").alias("gateway_id"), F.col("at").cast("double").alias("at"), "kind", "holder", F.col("rules").cast(RULE).alias("rules"),
    )
    state = F.lit(None).cast("string").alias("state")
    size = cols.groupBy("gateway_id").count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    if (size["most"] or 0) <= SLICE:
        return _decided(cols.select("*", state, F.lit(False).alias("goes_on"))).select("event_id", "allowed", "refused_by")
    spark = events.sparkSession
    folder, done = shared_folder(spark, "replay"), shared_folder(spark, "decided")
    dealt, turns = _dealt(cols, -(-size["all"] // SLICE), folder)
    rounds = defaultdict(list)
    for turn, part in turns.select("turn", "_slice").distinct().collect():
        rounds[turn].append(part)
    decided = spark.read.schema(DECIDED)
    for turn in sorted(rounds):
        now = turns.where(F.col("turn") == turn)
        some = dealt.where(F.col("slice").isin(rounds[turn])).join(now, F.col("gateway_id").eqNullSafe(F.col("_gateway")) & (F.col("slice") == F.col("_slice")))
        some = some.select(*cols.columns, state, "goes_on")
        if turn:
            before = decided.parquet(f"{done}/{turn - 1}").where("state is not null")
            some = some.unionByName(before.selectExpr("0L as event_id", "gateway_id", "cast(null as double) as at", "'kept' as kind", "key as holder", f"cast(null as {RULE}) as rules", "state", "true as goes_on"))
        _decided(some).write.parquet(f"{done}/{turn}")
    remove(spark, folder)
    return decided.parquet(*(f"{done}/{turn}" for turn in sorted(rounds))).where("state is null").select("event_id", "allowed", "refused_by")
