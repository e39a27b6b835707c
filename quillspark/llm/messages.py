"""Packed messages: arrays of rows for one bucket, as one binary value.

A mapper writes one value for each bucket it has rows for, so Spark moves a few
large rows instead of very many small ones.  A row of a message frame is the
bucket `k`, a tag `t` that says what the columns are, and the message `m`.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

MESSAGE = pa.schema([("k", pa.int32()), ("t", pa.int32()), ("m", pa.binary())])
SCHEMA = "k int, t int, m binary"
_KINDS = (np.dtype(np.int64), np.dtype(np.uint64), np.dtype(np.uint8), np.dtype(np.int32))


def put(*arrays: np.ndarray) -> bytes:
    """Arrays one after another; one that holds a single value many times is written once."""
    out = []
    for a in arrays:
        same = len(a) > 1 and bool((a == a[0]).all())
        out.append(struct.pack("<BI", _KINDS.index(a.dtype) + 8 * same, len(a)))
        out.append(a[:1].tobytes() if same else a.tobytes())
    return b"".join(out)


def get(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        kind, n = struct.unpack_from("<BI", raw, at)
        same, kind = divmod(kind, 8)
        a = np.frombuffer(raw, _KINDS[kind], 1 if same else n, at + 5)
        out.append(np.repeat(a, n) if same else a)
        at += 5 + a.nbytes
    return out


def messages(keys: np.ndarray, ids: np.ndarray, *cols: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Packed rows for each key; documents' ids are written once for all their rows."""
    order = np.lexsort((ids, keys))
    keys, ids, cols = keys[order], ids[order], [c[order] for c in cols]
    cut = np.flatnonzero(np.diff(keys)) + 1
    press = zstandard.ZstdCompressor(level=1)
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)], strict=True):
        if b > a:
            own, count = np.unique(ids[a:b], return_counts=True)
            head = press.compress(put(np.diff(own, prepend=np.int64(0)), count.astype(np.int32)))
            yield int(keys[a]), struct.pack("<I", len(head)) + head + put(*(c[a:b] for c in cols))


def unpacked(packed: list[bytes]) -> list[np.ndarray]:
    """Ids and columns of all messages together."""
    unpress, ids, cols = zstandard.ZstdDecompressor(), [], []
    for m in packed:
        (n,) = struct.unpack_from("<I", m)
        own, count = get(unpress.decompress(m[4 : 4 + n]))
        ids.append(np.repeat(np.cumsum(own), count))
        cols.append(get(m[4 + n :]))
    return [np.concatenate(ids), *(np.concatenate(c) for c in zip(*cols, strict=True))]


def table(rows: list[tuple[int, bytes]], tag: int = 0) -> pa.Table:
    return pa.table(
        [pa.array([k for k, _ in rows], pa.int32()), pa.array([tag] * len(rows), pa.int32()), pa.array([m for _, m in rows], pa.binary())],
        schema=MESSAGE,
    )


def tagged(told: pa.Table, tag: int) -> list[bytes]:
    """Messages of one tag."""
    return [m for t, m in zip(told.column("t").to_pylist(), told.column("m").to_pylist(), strict=True) if t == tag]
