"""Substring deduplication of words, by recompression.

Each round names runs of equal symbols and then pairs: a bit of a symbol's name
makes it a left or a right one, and a left one followed by a right one becomes a
new symbol.  Names are hashes of what they stand for, so every executor gives
equal substrings the same symbols without asking the others.  With each symbol
goes the stretch of words that decided it; inside a repeated window all symbols
whose stretch lies in the window are the same wherever the window occurs.

A window is dealt by the least-named symbol of the highest level that it decides;
groups of one document drop out.  What is left is verified on the words themselves:
a task numbers its different words, then pairs of words, pairs of pairs and so on
from one table each, so that equal windows, and they alone, get one number.
Words of a text that a window of `length` words covers are removed if the window
also starts in a document with a smaller id.  See `repeats` for the flow.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from quillspark.llm import repeats
from quillspark.llm.common import BLANKS, Chunk, WordTable, mix, pair_hash, window_hashes
from quillspark.llm.repeats import least_owner


class Symbols:
    """Symbols of one level: name, the units [low, high) that decide it, and its document."""

    __slots__ = ("name", "low", "high", "doc", "firsts")

    def __init__(self, name, low, high, doc, firsts):
        self.name, self.low, self.high, self.doc, self.firsts = name, low, high, doc, firsts


def first_level(units: np.ndarray, firsts: np.ndarray) -> Symbols:
    at = np.arange(len(units), dtype=np.int64)
    return Symbols(units, at, at + 1, np.repeat(np.arange(len(firsts) - 1), np.diff(firsts)), firsts)


def _neighbours(s: Symbols):
    """What decides the symbols before and after each; at a document's edge, a unit outside of it."""
    n = len(s.name)
    low, high = np.empty(n, np.int64), np.empty(n, np.int64)
    low[1:], high[:-1] = s.low[:-1], s.high[1:]
    edge = np.flatnonzero(np.diff(s.doc)) + 1
    begin, end = np.append(0, edge), np.append(edge - 1, n - 1)
    low[begin], high[end] = s.firsts[s.doc[begin]] - 1, s.firsts[s.doc[end] + 1] + 1
    return low, high


def name_runs(s: Symbols) -> Symbols:
    """Runs of one symbol become one; that a run ends is decided by its neighbours."""
    n = len(s.name)
    low, high = _neighbours(s)
    starts = np.empty(n, bool)
    starts[0] = True
    starts[1:] = (s.name[1:] != s.name[:-1]) | (s.doc[1:] != s.doc[:-1])
    first = np.flatnonzero(starts)
    last = np.append(first[1:], n) - 1
    size = last - first + 1
    name = s.name[first].copy()
    long = size > 1
    name[long] = pair_hash(name[long], size[long].astype(np.uint64))
    return Symbols(name, low[first], high[last], s.doc[first], s.firsts)


def name_pairs(s: Symbols, turn: int) -> Symbols:
    """Left symbols followed by right ones become pairs; the others are decided by who stands next to them."""
    n = len(s.name)
    left = (mix(s.name + np.uint64(0x9E3779B97F4A7C15 * (turn + 1) & (1 << 64) - 1)) >> np.uint64(63)).astype(bool)
    low, high = _neighbours(s)
    joins = np.zeros(n, bool)
    joins[:-1] = left[:-1] & ~left[1:] & (s.doc[1:] == s.doc[:-1])
    second = np.zeros(n, bool)
    second[1:] = joins[:-1]
    new_low, new_high = np.where(left, s.low, low), np.where(left, high, s.high)
    new_low[joins] = s.low[joins]
    at = np.flatnonzero(joins)
    new_high[at] = s.high[at + 1]
    name = s.name.copy()
    name[at] = pair_hash(s.name[at], s.name[at + 1])
    keep = ~second
    return Symbols(name[keep], new_low[keep], new_high[keep], s.doc[keep], s.firsts)


class WordWindows(repeats.Windows):
    """Windows of words; the digit is the least-named symbol that a window decides."""

    def __init__(self, length: int = 13, rounds: int = 2):
        self.length, self.rounds = length, rounds
        self.table = WordTable(BLANKS, lower=False)

    def units(self, chunk: Chunk):
        names, self.starts, self.stops, firsts = self.table.words(chunk)
        return names, firsts

    def digits(self, units: np.ndarray, firsts: np.ndarray):
        n = len(units) - self.length + 1
        hashes = window_hashes(units, self.length)
        if n <= 0:
            return hashes, np.zeros(0, np.int64), hashes
        whole = np.cumsum(np.append(np.uint64(0), mix(units) * np.uint64(0xD1342543DE82EF95)), dtype=np.uint64)
        levels, s = [], first_level(units, firsts)
        for turn in range(self.rounds):
            s = name_pairs(name_runs(s), turn)
            levels.append(s)
        # A window that decides no symbol (one long run, say) is its own digit.
        at, key = np.arange(n, dtype=np.int64), mix(hashes)
        open_ = np.ones(n, bool)
        for s in reversed(levels):
            order, begin = mix(s.name), np.arange(n, dtype=np.int64)[open_]
            a = np.searchsorted(s.low, begin, side="left")
            b = np.searchsorted(s.high, begin + self.length, side="right")
            found = b > a
            begin, a, b = begin[found], a[found], b[found]
            if not len(a):
                continue
            best, value = a.copy(), order[a]
            for step in range(1, int((b - a).max())):
                nxt = np.minimum(a + step, len(order) - 1)
                less = (a + step < b) & (order[nxt] < value)
                best[less], value[less] = nxt[less], order[nxt[less]]
            low, high = s.low[best], s.high[best]
            at[begin] = low
            # The words that decide the symbol belong to the digit, too.
            key[begin] = pair_hash(s.name[best], whole[high] - whole[low])
            open_[begin] = False
        return hashes, at, key

    def stretch(self, first: np.ndarray, last: np.ndarray):
        return self.starts[first], self.stops[last]

    def settle(self, stretches: Chunk):
        _, starts, stops, firsts = self.table.words(stretches)
        count = np.maximum(np.diff(firsts) - self.length + 1, 0)
        which = np.repeat(np.arange(len(count)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        if not len(at):
            return which, at
        group, ids = numbered_windows(numbered_words(stretches.data, starts, stops), self.length)[firsts[which] + at], stretches.ids[which]
        hit = least_owner(np.unique(group, return_inverse=True)[1], ids)[0] < ids
        return which[hit], at[hit]


def numbered_words(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A number for each word: equal for equal words, and for them alone."""
    raw, number = data.tobytes(), {}
    return np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], np.int64)


def numbered_windows(names: np.ndarray, length: int) -> np.ndarray:
    """A number for each run of `length` words: equal for equal runs, and for them alone."""
    pair = lambda a, b: np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]  # noqa: E731  numbers stay below the square of a task's words
    n = len(names) - length + 1
    have, at, out, level, width = length, 0, None, names, 1
    while have:
        if have & width:
            piece = level[at : at + n]
            out = piece if out is None else pair(out, piece)
            at += width
            have -= width
        if have:
            level = pair(level[:-width], level[width:])
            width *= 2
    return out


def deduplicate(docs: DataFrame, length: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, spans (removed, in words), kept (words joined by one blank) of every row."""
    return repeats.remove(docs, WordWindows(length), by_word=True).withColumnRenamed("n_units", "n_words")
