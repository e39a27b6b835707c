"""The limiter of several rules over a stream: all rules of a request or none, corrections, and leases that run out.

Events of a gateway are held until the watermark passes them and are then taken in the order of time
and id, so the decisions don't depend on the order of arrival and equal those of the batch replay
(`quotas.replay`).  An event that is behind the watermark is late: it is dropped before it reaches the state,
consumes nothing and has no decision.  State is what rules' keys have come to, which goes when nothing of it counts any more, and
the events not yet due.  Each call on a store goes through a socket, so keys share SHARES rows and events wait in packs.
"""

from __future__ import annotations

import json
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark.operators.quotas import RULE, Counters

DECISION = "event_id bigint, allowed boolean, refused_by string"
#: Rows that hold a gateway's keys, and the most events of a pack.
SHARES, PACK = 64, 10_000
_EVENT = pa.schema([("at", pa.float64()), ("event_id", pa.int64()), ("kind", pa.string()), ("holder", pa.string()), ("rules", pa.string())])


def _ms(seconds: float) -> int:
    """The first whole millisecond that isn't before it."""
    return math.ceil(seconds * 1000)


def _packs(events: pa.Table) -> list[tuple[float, bytes]]:
    """The first time and the events of each pack, in order of time."""
    out = []
    events = events.sort_by([("at", "ascending"), ("event_id", "ascending")])
    for at in range(0, len(events), PACK):
        part, sink = events.slice(at, PACK), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _EVENT, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(part)
        out.append((part["at"][0].as_py(), sink.getvalue().to_pybytes()))
    return out


def _unpacked(packs: list[bytes]) -> pa.Table:
    return pa.concat_tables([_EVENT.empty_table(), *(pa.ipc.open_stream(bytes(p)).read_all() for p in packs)])


class RuleLimiter(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "first double, events binary")
        self.rules = handle.getMapState("rules", "share int", "state string")
        self.armed = handle.getValueState("armed", "ms bigint")

    def _wake(self, ms: int) -> None:
        """One timer a key: the earliest that is wanted."""
        now = self.armed.get()[0] if self.armed.exists() else None
        if now is None or ms < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(ms)
            self.armed.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        packs = [p for frame in rows for p in _packs(pa.Table.from_pandas(frame[_EVENT.names], schema=_EVENT, preserve_index=False))]
        self.waiting.appendList(packs)
        self._wake(_ms(min(first for first, _ in packs)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.armed.clear()
        now = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        # A pack of which nothing is due stays as it is.
        later = [(first, events) for first, events in held if _ms(first) > now]
        opened = _unpacked([events for first, events in held if _ms(first) <= now])
        is_due = np.ceil(opened["at"].to_numpy() * 1000) <= now
        due = opened.filter(pa.array(is_due)).sort_by([("at", "ascending"), ("event_id", "ascending")])
        rest = later + _packs(opened.filter(pa.array(~is_due)))
        (store, until), ends, out = self._loaded(), {}, []
        for at, e, kind, holder, text in zip(*(c.to_pylist() for c in due.columns), strict=True):
            rules = json.loads(text or "[]")
            for r in rules:
                # Two windows on, or when the last lease has run out, nothing of a rule counts any more.
                ends[r["key"]] = max(ends.get(r["key"], 0), _ms(at + 2 * r["span"]))
            if kind == "consume":
                refused = store.consume(rules, at, holder)
                out.append((e, refused is None, refused))
            elif kind == "settle":
                store.settle(rules, at)
            else:
                store.release(rules, holder)
        until.update(ends)
        left = {name: ms for name, ms in until.items() if ms > now}
        if ends or len(left) < len(until):
            self._keep(store, left)
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        next_ = [*left.values(), *(_ms(first) for first, _ in rest)]
        if next_:
            self._wake(min(next_))
        if out:
            yield pd.DataFrame(out, columns=["event_id", "allowed", "refused_by"]).astype({"refused_by": object})

    def _loaded(self) -> tuple[Counters, dict[str, int]]:
        """What the keys have come to, and until when each counts."""
        store, until = Counters(), {}
        for _, (text,) in self.rules.iterator():
            for name, (counts, leases, ms) in json.loads(text).items():
                store.counts[name], store.leases[name], until[name] = {int(s): v for s, v in counts}, dict(leases), ms
        return store, until

    def _keep(self, store: Counters, until: dict[str, int]) -> None:
        shares = defaultdict(dict)
        for name, ms in until.items():
            shares[zlib.crc32(name.encode()) % SHARES][name] = [list(store.counts.get(name, {}).items()), list(store.leases.get(name, {}).items()), ms]
        self.rules.clear()
        for share, state in shares.items():
            self.rules.updateValue((share,), (json.dumps(state),))

    def close(self) -> None:
        pass


def limited(stream: DataFrame, delay: str) -> DataFrame:
    """event_id, allowed, refused_by of every `consume` of a stream of event_id, gateway_id, ts, kind, holder, rules (as `quotas.replay` takes them).

    `delay` is how far events may come out of order.  Needs the RocksDB state store.
    """
    cols = stream.withWatermark("ts", delay).select(
        "event_id", "gateway_id", "ts", (F.unix_micros("ts") / 1e6).alias("at"), "kind", "holder", F.to_json(F.col("rules").cast(RULE)).alias("rules")
    )
    return cols.groupBy("gateway_id").transformWithStateInPandas(RuleLimiter(), DECISION, "Append", "EventTime")
