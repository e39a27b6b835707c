"""Completions put together again from the frames of their streams.

Frames of a request may come in any order.  Those that follow on what is there are
joined; others wait in a buffer until the gap before them closes.  A completion ends with its
final frame once no gap is left before it, or when no frame has come for `quiet` of event
time: then it is what stands before the first gap, and marked as incomplete.  At most `most` characters
are kept, however long the stream is, and what is cut is marked; the buffer is bounded by `buffered`
frames, beyond which a completion is closed as it stands.

Defined cases: a frame that comes again counts once; a null content is an empty one; a frame after the end or behind the
watermark is dropped; a request whose first frame is missing gives an empty, incomplete text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

COMPLETION = "request_id bigint, text string, frames bigint, truncated boolean, complete boolean, usage bigint"
_COLUMNS = [c.split()[0] for c in COMPLETION.split(", ")]


class Reassembly(StatefulProcessor):
    def __init__(self, most: int, quiet_ms: int, buffered: int):
        self.most, self.quiet_ms, self.buffered = most, quiet_ms, buffered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "text string")
        self.gap = handle.getMapState("gap", "seq bigint", "content string, last boolean")
        self.head = handle.getValueState("head", "next bigint, length bigint, truncated boolean, usage bigint, due bigint, done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        head = self.head.get()
        next_, length, truncated, usage, due, done = head or (0, 0, False, None, 0, False)
        if done:
            return
        # A request that is new has nothing in the other states, and what ends at once never goes there.
        waiting = {int(s): (c, last) for (s,), (c, last) in self.gap.iterator()} if head else {}
        held, pieces, newest = set(waiting), [], 0
        frames = [f for frame in rows for f in zip(*(frame[c].tolist() for c in ("seq", "content", "last", "usage", "at_ms")), strict=True)]
        for seq, content, last, used, at in sorted(frames, key=lambda f: f[0]):
            newest = max(newest, int(at))
            if seq >= next_:
                waiting.setdefault(int(seq), (content or "", bool(last)))
            if pd.notna(used):
                usage = int(used)
        ended = False
        while next_ in waiting and not ended:
            content, ended = waiting.pop(next_)
            room = self.most - length
            if content and len(content) > room:
                truncated = True
            if content and room > 0:
                pieces.append(content[:room])
                length += min(len(content), room)
            if next_ in held:
                self.gap.removeKey((next_,))
            next_ += 1
        if due:
            self.handle.deleteTimer(due)
        due = max(due, newest + self.quiet_ms)
        if ended or len(waiting) > self.buffered:
            yield self._closed(key, next_, truncated, ended, usage, pieces, bool(head))
            # Until the stream is quiet, what still comes is known to be too late.
            self.head.update((next_, length, truncated, usage, due, True))
        else:
            if pieces:
                self.parts.appendValue(("".join(pieces),))
            for seq in set(waiting) - held:
                self.gap.updateValue((seq,), waiting[seq])
            self.head.update((next_, length, truncated, usage, due, False))
        self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        next_, _, truncated, usage, _, done = self.head.get()
        if not done:
            yield self._closed(key, next_, truncated, False, usage, [], True)
        self.head.clear()

    def _closed(self, key, frames: int, truncated: bool, complete: bool, usage, pieces: list[str], held: bool) -> pd.DataFrame:
        text = "".join([*(t for (t,) in self.parts.get()), *pieces] if held else pieces)
        if held:
            self.parts.clear()
            self.gap.clear()
        return pd.DataFrame([(int(key[0]), text, frames, truncated, complete, usage)], columns=_COLUMNS).astype({"usage": "Int64"})

    def close(self) -> None:
        pass


def completions(stream: DataFrame, most: int = 64_000, quiet: int = 30, buffered: int = 10_000, delay: str = "30 seconds") -> DataFrame:
    """request_id, text, frames, truncated, complete, usage of a stream of frames: request_id, ts, seq (from 0), content, last, usage.

    `quiet` is in seconds of event time; `delay` is how far frames may come out of order in time.
    """
    cols = stream.withWatermark("ts", delay).selectExpr("request_id", "ts", "unix_millis(ts) as at_ms", "seq", "content", "coalesce(last, false) as last", "usage")
    return cols.groupBy("request_id").transformWithStateInPandas(Reassembly(most, quiet * 1000, buffered), COMPLETION, "Append", "EventTime")
