"""Suffix-array deduplication of bytes, by depth-limited radix passes.

Only the order of suffixes through their first `length` bytes matters, and only
who shares a prefix of that depth.

* Suffixes are dealt to tasks by a string of 16 bytes that each picks from its
  first `length` bytes (the one whose name is smallest), so that neighbouring
  suffixes share it and travel as one run.  Equal runs are settled by the smallest
  document: both the 64-bit name of the string and that of the run must agree.
* The suffixes of runs that are still open meet as stretches of text.  Passes by the
  most significant digit order them: a digit is the next eight bytes, and a group
  that one document owns alone is dropped after each pass.  Groups equal through
  `length` bytes are exactly the repeated windows; no hash decides there.

Bytes of a text that such a window covers are removed if the window also starts
in a document with a smaller id.  See `repeats` for the flow and its bounds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from quillspark.llm import repeats
from quillspark.llm.common import Chunk, rng_table, window_hashes
from quillspark.llm.repeats import least_owner

DIGIT = 8


class ByteWindows(repeats.Windows):
    """Windows of bytes; the digit is the least-named `gram` bytes of a window."""

    def __init__(self, length: int = 50, gram: int = 16):
        self.length, self.gram = length, gram
        self.names = rng_table(3, 256)

    def units(self, chunk: Chunk):
        return self.names[chunk.data], chunk.offsets

    def digits(self, units: np.ndarray, firsts: np.ndarray):
        n = len(units) - self.length + 1
        hashes, names = window_hashes(units, self.length, also=self.gram)
        if n <= 0:
            return hashes, np.zeros(0, np.int64), hashes
        # The high half of a value is a gram's scrambled name, the low half its place: the least is the least-named, leftmost one.
        value = names * np.uint64(0x9E6C63D0876A9A47)
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xC13FA9A902A6328F)
        value &= np.uint64(0xFFFFFFFF00000000)
        value |= np.arange(len(value), dtype=np.uint64)
        reach, width = self.length - self.gram + 1, 1
        while width * 2 <= reach:
            value = np.minimum(value[:-width], value[width:])
            width *= 2
        if width < reach:
            value = np.minimum(value[: width - reach], value[reach - width :])
        at = (value[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return hashes, at, names[at]

    def stretch(self, first: np.ndarray, last: np.ndarray):
        return first, last + 1

    def settle(self, stretches: Chunk):
        which, at, ids, group = radix_groups(stretches, self.length)
        hit = least_owner(group, ids)[0] < ids
        return which[hit], at[hit]


def radix_groups(stretches: Chunk, length: int):
    """(stretch, place, id, group) of suffixes equal through `length` bytes that several ids own; by most-significant-digit passes."""
    count = np.maximum(np.diff(stretches.offsets) - length + 1, 0)
    which = np.repeat(np.arange(len(count)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    ids = stretches.ids[which]
    # The bytes at each place as one big-endian number; what lies past the end of the data is never part of a digit.
    data = np.concatenate((stretches.data, np.zeros(DIGIT, np.uint8))).astype(np.uint64)
    value = np.zeros(len(stretches.data), np.uint64)
    for k in range(DIGIT):
        value |= data[k : k + len(value)] << np.uint64(8 * (DIGIT - 1 - k))
    group = np.zeros(len(at), np.int64)
    for depth in range(0, length, DIGIT):
        if not len(at):
            break
        digit = value[stretches.offsets[which] + at + depth]
        if length - depth < DIGIT:
            digit >>= np.uint64(8 * (DIGIT - length + depth))
        order = np.lexsort((digit, group))
        which, at, ids, group, digit = which[order], at[order], ids[order], group[order], digit[order]
        new = np.append(True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1]))
        group = np.cumsum(new) - 1
        low, high = least_owner(group, ids)
        shared = low < high
        which, at, ids, group = which[shared], at[shared], ids[shared], group[shared]
    return which, at, ids, group


def deduplicate(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (removed, in bytes), kept (bytes) of every row."""
    return repeats.remove(docs, ByteWindows(length), by_word=False).withColumnRenamed("n_units", "n_bytes")
