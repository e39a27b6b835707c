"""Removal of what repeats across documents: the flow that byte and word windows share.

    texts --digits--> buckets --whole runs or windows--> buckets --hits--> texts

1. Every window of a text has a digit, a place in it chosen by content alone.
   Consecutive windows with one digit are a run.  Runs go to buckets as (digit
   name, run name, document).  A digit that one document owns alone is dropped.
   A run that a smaller document has, too, is a hit as a whole.  The first owners
   of the different runs of one digit are left to the next pass.
2. Those owners send the stretch of text of each open run to its digit's bucket,
   where its windows are compared; a window that a smaller document has, too, is
   a hit.  Runs of a digit with very many different runs send their windows
   instead, each to a bucket of its own.
3. Hits go back to the texts, and what they cover is removed.

Bounds.  Messages are packed arrays, by bucket.  The number of buckets and of
text groups follows from the bytes of all texts, so that either fits a task at
any input size.  Before the shuffle, a chunk sends one row for each run however
many of its documents have it, and for a digit common to very many of its
documents it sends one row and leaves those documents to pass 2 at once; a text
group sends each window once.  So no key, however common, sends more than a few
rows a chunk or group.

Defined cases: a null or empty text has no windows and is kept as an empty one;
rows with one doc_id don't remove each other's text; a null doc_id counts as
larger than all others; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Chunk, groups_for, in_sorted, mix, pair_hash, text_bytes, text_chunks, window_hashes
from quillspark.llm.messages import SCHEMA, get, messages, put, table, tagged, unpacked

GROUP_BYTES, BUCKET_BYTES = 2 << 20, 8 << 20
#: A digit in more documents of one chunk than this is common; its runs skip pass 1.
COMMON = 64
NO_ID, MARK = (1 << 63) - 1, -(1 << 63)
#: A digit with more different runs than this goes on by windows, not by whole stretches.
WIDE = 1024
SETTLED, OPEN, DIRECT = 0, 1, 2
#: Tags: runs; settled runs; open runs; stretches of open runs; windows; windows that are hits; hits within runs.
RUN, SETTLED_RUN, OPEN_RUN, STRETCH, WINDOW, HIT, MASK = range(7)


class Windows:
    """What a kind of window must say: its units, and the digit of each window."""

    length: int

    def units(self, chunk: Chunk):
        """(name of each unit, first unit of each document and the end)."""
        raise NotImplementedError

    def digits(self, units: np.ndarray, firsts: np.ndarray):
        """(hash of each window, place of its digit, name of its digit); windows may span documents."""
        raise NotImplementedError

    def stretch(self, first: np.ndarray, last: np.ndarray):
        """First and end byte of units first..last of the chunk that `units` saw last."""
        raise NotImplementedError

    def settle(self, stretches: Chunk):
        """(stretch, number of the window in it) of every window of the stretches that one with a smaller id has, too; by the units themselves."""
        raise NotImplementedError


def least_owner(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest id of each row's group; groups are numbered from 0."""
    n = int(group.max()) + 1 if len(group) else 0
    low, high = np.full(n, NO_ID, np.int64), np.full(n, -NO_ID, np.int64)
    np.minimum.at(low, group, ids)
    np.maximum.at(high, group, ids)
    return low[group], high[group]


class Runs:
    """Runs of a chunk's windows: document, first window, number of windows, digit name, run name."""

    def __init__(self, kind: Windows, chunk: Chunk):
        self.units, self.firsts = kind.units(chunk)
        n, length = len(self.units), kind.length
        self.hashes, at, key = kind.digits(self.units, self.firsts)
        size = np.diff(self.firsts)
        doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
        if n < length:
            self.doc = np.zeros(0, np.int32)
            self.first = self.count = np.zeros(0, np.int64)
            self.key = self.name = np.zeros(0, np.uint64)
            return
        valid = doc[: n - length + 1] == doc[length - 1 :]
        doc = doc[: n - length + 1]
        starts = np.empty(len(doc), bool)
        starts[0] = True
        starts[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(starts)
        count = np.diff(np.append(first, len(doc)))
        real = valid[first]
        first, count = first[real], count[real]
        # A run of more windows than a window is long has gaps between its outer windows; cut it.
        if len(count) and count.max() > length:
            parts = -(-count // length)
            base = np.repeat(first, parts)
            k = np.arange(len(base)) - np.repeat(np.cumsum(parts) - parts, parts)
            total = np.repeat(count, parts)
            first, count = base + k * length, np.minimum(length, total - k * length)
        self.doc, self.first, self.count, self.key = doc[first], first, count, key[first]
        last = first + count - 1
        inner = (count << 32).astype(np.uint64) + (at[first] - first).astype(np.uint64)
        self.name = pair_hash(pair_hash(self.hashes[first], self.hashes[last]), inner)

    def windows(self, pick: np.ndarray):
        """(window numbers, document) of the picked runs."""
        count = self.count[pick]
        at = np.repeat(self.first[pick] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return at, np.repeat(self.doc[pick], count)


def _ids(chunk: Chunk) -> np.ndarray:
    return chunk.ids.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _send_runs(kind: Windows, buckets: int):
    """Pass 1, at the texts: each run once a chunk, by digit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch, limit=1 << 20):
                runs = Runs(kind, chunk)
                if not len(runs.first):
                    continue
                ids = _ids(chunk)[runs.doc]
                order = np.lexsort((ids, runs.name, runs.key))
                key, name, own = runs.key[order], runs.name[order], ids[order]
                new_key = np.append(True, key[1:] != key[:-1])
                new_name = new_key | np.append(True, name[1:] != name[:-1])
                new_id = new_name | np.append(True, own[1:] != own[:-1])
                which = np.cumsum(new_key) - 1
                common = np.bincount(which, weights=new_name)[which] > COMMON
                state = np.where(common, DIRECT, OPEN).astype(np.uint8)
                # A run that a smaller document of this chunk has is settled here.
                least = own[np.flatnonzero(new_name)][np.cumsum(new_name) - 1]
                state[own > least] = SETTLED
                # A common digit is told to its bucket by one mark, so that whoever else has it is left open, too.
                marks = key[new_key & common]
                key, name, own, state = key[new_id], name[new_id], own[new_id], state[new_id]
                bucket = np.where(state == OPEN, key % np.uint64(buckets), mix(own.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                if len(marks):
                    n = len(marks)
                    key, name = np.append(key, marks), np.append(name, np.zeros(n, np.uint64))
                    own, state = np.append(own, np.full(n, MARK)), np.append(state, np.full(n, OPEN, np.uint8))
                    bucket = np.append(bucket, (marks % np.uint64(buckets)).astype(np.int64))
                yield from table(list(messages(bucket, own, key, name, state))).to_batches()

    return run


def _settle_runs(groups: int):
    """Pass 1, at the buckets: (document, run, settled or open) for the texts."""

    def run(told: pa.Table) -> pa.Table:
        own, key, name, state = unpacked(told.column("m").to_pylist())
        hits = [(own[state == SETTLED], name[state == SETTLED])]
        left = [(own[state == DIRECT], name[state == DIRECT], key[state == DIRECT], np.ones(int((state == DIRECT).sum()), np.uint8))]
        own, key, name = own[state == OPEN], key[state == OPEN], name[state == OPEN]
        if len(own):
            order = np.argsort(key, kind="stable")
            own, key, name = own[order], key[order], name[order]
            same = np.append(False, key[1:] == key[:-1])
            many = same | np.append(same[1:], False)
            own, key, name = own[many], key[many], name[many]
        if len(own):
            order = np.lexsort((own, name, key))
            own, key, name = own[order], key[order], name[order]
            new_key = np.append(True, key[1:] != key[:-1])
            new_name = new_key | np.append(True, name[1:] != name[:-1])
            first = np.flatnonzero(new_name)
            hit = own > own[first][np.cumsum(new_name) - 1]
            hits.append((own[hit], name[hit]))
            # Owners of the runs of one digit, where there are several runs and several owners.
            which = (np.cumsum(new_key) - 1)[first]
            owner = own[first]
            begin = np.flatnonzero(new_key[first])
            low, high = np.minimum.reduceat(owner, begin), np.maximum.reduceat(owner, begin)
            wide = ((np.bincount(which) > WIDE) | (low == MARK))[which]
            go = (low < high)[which] & (owner != MARK)
            left.append((owner[go], name[first][go], key[first][go], wide[go].astype(np.uint8)))
        ids, names = (np.concatenate(c) for c in zip(*hits, strict=True))
        out = table(list(messages(group_of(ids, groups), ids, names)), SETTLED_RUN)
        ids, names, keys, wide = (np.concatenate(c) for c in zip(*left, strict=True))
        return pa.concat_tables([out, table(list(messages(group_of(ids, groups), ids, names, keys, wide)), OPEN_RUN)])

    return run


def pack_texts(groups: int):
    """Texts of each batch by group, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for chunk in text_chunks(batch, limit=16 << 20):
                ids = _ids(chunk)
                group = group_of(ids, groups)
                order = np.argsort(group, kind="stable")
                cut = np.flatnonzero(np.diff(group[order])) + 1
                rows = []
                for rows_at in np.split(order, cut):
                    sizes = np.diff(chunk.offsets)[rows_at]
                    raw = b"".join(chunk.raw(i) for i in rows_at.tolist())
                    head = put(ids[rows_at], sizes.astype(np.int64))
                    rows.append((int(group[rows_at[0]]), struct.pack("<I", len(head)) + head + press.compress(raw)))
                yield from table(rows).to_batches()

    return run


def unpack_texts(messages: list[bytes]) -> Chunk | None:
    """All texts of a group; with one message as many as it holds."""
    ids, sizes, parts = [], [], []
    unpress = zstandard.ZstdDecompressor()
    for m in messages:
        (n,) = struct.unpack_from("<I", m)
        i, s = get(m[4 : 4 + n])
        ids.append(i)
        sizes.append(s)
        parts.append(unpress.decompress(m[4 + n :], max_output_size=max(1, int(s.sum()))) if s.sum() else b"")
    if not ids:
        return None
    data = np.frombuffer(b"".join(parts), np.uint8)
    offsets = np.cumsum(np.concatenate(([0], *sizes)))
    return Chunk((0, len(offsets) - 1), np.concatenate(ids), None, data, offsets)


def part_of(chunk: Chunk, pick: np.ndarray) -> Chunk:
    """The picked texts of a chunk."""
    sizes = np.diff(chunk.offsets)[pick]
    data = np.concatenate([chunk.data[chunk.offsets[i] : chunk.offsets[i + 1]] for i in pick.tolist()] or [np.zeros(0, np.uint8)])
    return Chunk((0, len(pick)), chunk.ids[pick], None, data, np.cumsum(np.append(0, sizes)))


def _tag(ids: np.ndarray, names: np.ndarray) -> np.ndarray:
    return pair_hash(names, ids.astype(np.uint64))


def _send_windows(kind: Windows, buckets: int):
    """Pass 2, at the texts: open runs as stretches of text by digit, those of wide digits as windows, each once a group."""

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        chunk = unpack_texts(texts.column("m").to_pylist())
        if chunk is None or not told.num_rows:
            return table([])
        own, name, key, wide = unpacked(told.column("m").to_pylist())
        need = np.flatnonzero(np.isin(chunk.ids, own))
        if not len(need):
            return table([])
        chunk = part_of(chunk, need)
        runs = Runs(kind, chunk)
        tags = _tag(chunk.ids[runs.doc], runs.name)
        narrow = in_sorted(np.unique(_tag(own, name)[wide == 0]), tags)
        open_ = in_sorted(np.unique(_tag(own, name)[wide == 1]), tags) & ~narrow
        # Stretches: one for each document and run.
        pick = np.flatnonzero(narrow)
        pick = pick[np.unique(tags[pick], return_index=True)[1]]
        begin, end = kind.stretch(runs.first[pick], runs.first[pick] + runs.count[pick] + kind.length - 2)
        bucket = (runs.key[pick] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        press, rows = zstandard.ZstdCompressor(level=3), []
        for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            if len(at):
                at = at[np.argsort(pick[at], kind="stable")]
                raw = b"\n".join(chunk.data[a:b].tobytes() for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True))
                head = put(chunk.ids[runs.doc[pick[at]]], (end[at] - begin[at]).astype(np.int32))
                body = press.compress(struct.pack("<I", len(head)) + head + raw)
                rows.append((int(bucket[at[0]]), struct.pack("<I", len(body)) + body + put(runs.name[pick[at]])))
        out = [table(rows, STRETCH)]
        at, doc = runs.windows(np.flatnonzero(open_))
        if len(at):
            hashes, ids, check = runs.hashes[at], chunk.ids[doc], window_hashes(mix(runs.units + np.uint64(29)), kind.length)[at]
            order = np.lexsort((ids, check, hashes))
            hashes, ids, check = hashes[order], ids[order], check[order]
            new = np.append(True, (hashes[1:] != hashes[:-1]) | (check[1:] != check[:-1]))
            fresh = new | np.append(True, ids[1:] != ids[:-1])
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            least = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
            state = (ids == least).astype(np.uint8)
            spread = (mix(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            bucket[state == 0] = spread[state == 0]
            out.append(table(list(messages(bucket[fresh], ids[fresh], hashes[fresh], check[fresh], state[fresh])), WINDOW))
        return pa.concat_tables(out)

    return run


def _first_owner(hashes: np.ndarray, check: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row the smallest id that has the row's window, by both of its hashes."""
    order = np.lexsort((ids, check, hashes))
    hashes, check, ids = hashes[order], check[order], ids[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (check[1:] != check[:-1]))
    out = np.empty(len(ids), np.int64)
    out[order] = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _settle_windows(kind: Windows, groups: int):
    """Pass 2, at the buckets: which windows of each stretch, and which single windows, are hits."""

    def run(told: pa.Table) -> pa.Table:
        out = [table([])]
        stretches, ids, sizes, names, parts = tagged(told, STRETCH), [], [], [], []
        for m in stretches:
            (n,) = struct.unpack_from("<I", m)
            body = zstandard.ZstdDecompressor().decompress(m[4 : 4 + n])
            (k,) = struct.unpack_from("<I", body)
            i, s = get(body[4 : 4 + k])
            ids.append(i)
            sizes.append(s)
            names += get(m[4 + n :])
            parts.append(body[4 + k :])
        if stretches:
            ids, sizes, names = np.concatenate(ids), np.concatenate(sizes).astype(np.int64), np.concatenate(names)
            data = np.frombuffer(b"\n".join(parts), np.uint8)
            # Each stretch is a text of its own; the byte between two of them belongs to neither.
            real = np.ones(len(data), bool)
            real[(np.cumsum(sizes + 1) - 1)[:-1]] = False
            data = data[real]
            stretch = Chunk((0, len(ids)), ids, None, data, np.cumsum(np.append(0, sizes)))
            which, at = kind.settle(stretch)
            mask = np.zeros(len(ids), np.uint64)
            np.bitwise_or.at(mask, which, np.uint64(1) << at.astype(np.uint64))
            some = mask > 0
            out.append(table(list(messages(group_of(ids[some], groups), ids[some], names[some], mask[some])), MASK))
        if windows := tagged(told, WINDOW):
            own, name, check, state = unpacked(windows)
            hit = (state == 0) | (_first_owner(name, check, own) < own)
            out.append(table(list(messages(group_of(own[hit], groups), own[hit], name[hit])), HIT))
        return pa.concat_tables(out)

    return run


_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_units", pa.int64()),
        ("n_removed", pa.int64()),
        ("n_spans", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("kept", pa.binary()),
    ]
)


def _apply(kind: Windows, by_word: bool):
    """Pass 3: what the hits of each text cover is removed."""

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        chunk = unpack_texts(texts.column("m").to_pylist())
        if chunk is None:
            return _RESULT.emptytable()
        n = len(chunk)
        units, firsts = kind.units(chunk)
        cover = np.zeros(len(units) + 1, np.int32)
        bounds = (kind.starts, kind.stops) if by_word else None
        if told.num_rows:
            none = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            whole_id, whole = unpacked(m) if (m := tagged(told, SETTLED_RUN)) else none
            part_id, part_name, mask = unpacked(m) if (m := tagged(told, MASK)) else (*none, none[1])
            hit_id, hit = unpacked(m) if (m := tagged(told, HIT)) else none
            need = np.flatnonzero(np.isin(chunk.ids, np.concatenate((whole_id, part_id, hit_id))))
            part = part_of(chunk, need)
            runs = Runs(kind, part)
            shift = firsts[need] - runs.firsts[:-1]  # from units of the part to units of the chunk
            tags = _tag(part.ids[runs.doc], runs.name)
            settled = in_sorted(np.unique(_tag(whole_id, whole)), tags)
            np.add.at(cover, runs.first[settled] + shift[runs.doc[settled]], 1)
            np.add.at(cover, runs.first[settled] + runs.count[settled] - 1 + kind.length + shift[runs.doc[settled]], -1)
            known, where = np.unique(_tag(part_id, part_name), return_index=True)
            pick = np.flatnonzero(~settled & in_sorted(known, tags))
            at, doc = runs.windows(pick)
            bits = np.repeat(mask[where[np.searchsorted(known, tags[pick])]], runs.count[pick]) if len(pick) else mask[:0]
            got = (bits >> (at - np.repeat(runs.first[pick], runs.count[pick])).astype(np.uint64) & np.uint64(1)).astype(bool)
            at, doc = [at[got]], [doc[got]]
            if len(hit):
                more, its = runs.windows(np.flatnonzero(~settled))
                got = in_sorted(np.unique(_tag(hit_id, hit)), _tag(part.ids[its], runs.hashes[more]))
                at.append(more[got])
                doc.append(its[got])
            at, doc = np.concatenate(at), np.concatenate(doc)
            np.add.at(cover, at + shift[doc], 1)
            np.add.at(cover, at + kind.length + shift[doc], -1)
        gone = np.cumsum(cover[:-1]) > 0
        cols = {k: [] for k in _RESULT.names}
        for i in range(n):
            a, b = int(firsts[i]), int(firsts[i + 1])
            own_gone = gone[a:b]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], own_gone.view(np.int8), [0]))))
            spans = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
            if by_word:
                data = chunk.data
                left = a + np.flatnonzero(~own_gone)
                kept = b" ".join(chunk.raw(i).split()) if not spans else b" ".join(
                    data[x:y].tobytes() for x, y in zip(bounds[0][left].tolist(), bounds[1][left].tolist(), strict=True)
                )
            else:
                kept = chunk.data[a:b][~own_gone].tobytes()
            cols["doc_id"].append(None if chunk.ids[i] == NO_ID else int(chunk.ids[i]))
            cols["n_units"].append(b - a)
            cols["n_removed"].append(int(own_gone.sum()))
            cols["n_spans"].append(len(spans))
            cols["spans"].append([{"start": x, "end": y} for x, y in spans])
            cols["kept"].append(kept)
        return pa.table([pa.array(cols[k], _RESULT.field(k).type) for k in _RESULT.names], schema=_RESULT)

    return run


def remove(docs: DataFrame, kind: Windows, by_word: bool) -> DataFrame:
    """doc_id, n_units, n_removed, n_spans, spans, kept of every row of `docs`."""
    if not 1 <= kind.length <= 64:
        raise ValueError("a window has 1 to 64 units: the hits of a run are bits of one number")
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size, least = text_bytes(texts), int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, groups = max(least, groups_for(size, BUCKET_BYTES)), max(least, groups_for(size, GROUP_BYTES))
    packed = texts.mapInArrow(pack_texts(groups), SCHEMA)
    runs = texts.mapInArrow(_send_runs(kind, buckets), SCHEMA).groupBy("k").applyInArrow(_settle_runs(groups), SCHEMA)
    open_ = runs.where(F.col("t") == OPEN_RUN)
    windows = packed.groupBy("k").cogroup(open_.groupBy("k")).applyInArrow(_send_windows(kind, buckets), SCHEMA)
    hits = windows.groupBy("k").applyInArrow(_settle_windows(kind, groups), SCHEMA)
    told = runs.where(F.col("t") == SETTLED_RUN).unionByName(hits)
    result = "doc_id bigint, n_units bigint, n_removed bigint, n_spans bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    return packed.groupBy("k").cogroup(told.groupBy("k")).applyInArrow(_apply(kind, by_word), result)
