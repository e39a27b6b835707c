"""Benchmark decontamination with one Aho-Corasick automaton.

Every benchmark text (questions and answers alike) is lower-cased and cut into
windows of `window` words; a shorter text is one window.  All windows form one
automaton over the numbers of the benchmark's words, and each document's
normalised words run through it once.  Matches are word numbers, which are mapped
to code-point spans of the original text.

The distinct windows are a Spark table.  Their number is counted before anything is
broadcast: a block of at most about `max_windows` of them at a time.  A benchmark
of more windows takes several blocks; each row then carries what earlier blocks
found in its own text, so results depend neither on the blocks nor on ids.

Defined cases: a null or empty text has no words and no hits; a null item text
has no windows; a null item_id is no item's name, but its windows count as hits;
repeated rows and rows that share an id are judged each by its own text; an empty
benchmark hits nothing; other columns are ignored (`uncontaminated` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.llm.common import Scratch, groups_for

#: A-Z folds to a-z; every other ASCII character but 0-9 and a-z parts words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: What a row carries from block to block: hit words as first and past-last number of each stretch, and items.
_CARRIED = {"_quill_hits": "array<bigint>", "_quill_items": "array<string>"}
RESULT = "doc_id bigint, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def item_windows(words: list[bytes], window: int) -> set[bytes]:
    if not words:
        return set()
    if len(words) <= window:
        return {b" ".join(words)}
    return {b" ".join(words[i : i + window]) for i in range(len(words) - window + 1)}


class Matcher:
    """An automaton over word numbers; a word that no window has is number 0."""

    def __init__(self, windows: pa.Table):
        self.number: dict[bytes, int] = {}
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for text, items in zip(windows["w"].to_pylist(), windows["items"].to_pylist(), strict=True):
            key = tuple(self.number.setdefault(w, len(self.number) + 1) for w in text.split(b" "))
            self.auto.add_word(key, (len(key), items))
        self.auto.make_automaton()

    def match(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """Stretches of hit words (first, past the last, ...) and items."""
        if not len(self.auto):
            return [], set()
        line = tuple(map(self.number.get, words, repeat(0)))
        ends: list[tuple[int, int]] = []
        items: set[str] = set()
        for last, (length, names) in self.auto.iter(line):
            ends.append((last + 1 - length, last + 1))
            items.update(names)
        return stretches(ends), items


def stretches(ranges: list[tuple[int, int]]) -> list[int]:
    """The union of ranges, in order: first, past the last, first, ..."""
    out: list[int] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += (a, b)
    return out


def spans_of(text: str, hits: list[int]) -> list[dict]:
    """Stretches of hit words as code-point spans of the original text."""
    if not hits:
        return []
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    inside = np.frombuffer(raw.translate(_FOLD), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    point = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    starts, ends = point[np.flatnonzero(edge == 1)], point[np.flatnonzero(edge == -1)]
    return [{"start": int(starts[a]), "end": int(ends[b - 1])} for a, b in zip(hits[::2], hits[1::2], strict=True)]


def _found(matcher: Matcher, batch: pa.RecordBatch):
    """(text, words, hits, items) of each row, with what earlier blocks found."""
    of = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
    for text, hits, items in zip(of("text"), of("_quill_hits"), of("_quill_items"), strict=True):
        words = words_of(text)
        more, names = matcher.match(words)
        if hits:
            more = stretches([*zip(hits[::2], hits[1::2], strict=True), *zip(more[::2], more[1::2], strict=True)])
            names.update(items)
        yield text, len(words), more, sorted(names)


def _hit(hits: list[int]) -> int:
    return sum(hits[1::2]) - sum(hits[::2])


def _carry(block):
    """What one block finds, added to what the rows carry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block.value)
        for batch in batches:
            rows = [(hits, items) for _, _, hits, items in _found(matcher, batch)]
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            cols["_quill_hits"] = pa.array([h for h, _ in rows], pa.list_(pa.int64()))
            cols["_quill_items"] = pa.array([i for _, i in rows], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return run


def _tell(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                rows = list(_found(matcher, piece))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(piece.schema.get_field_index("doc_id")),
                        pa.array([n for _, n, _, _ in rows], pa.int64()),
                        pa.array([_hit(h) for _, _, h, _ in rows], pa.int64()),
                        pa.array([i for *_, i in rows], pa.list_(pa.string())),
                        pa.array([spans_of(t, h) for t, _, h, _ in rows], _SPANS),
                    ],
                    ["doc_id", "n_words", "n_hit", "items", "spans"],
                )

    return run


def _keep(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                keep = [not h or 20 * _hit(h) < n for _, n, h, _ in _found(matcher, piece)]
                yield piece.select([c for c in piece.schema.names if c not in _CARRIED]).filter(pa.array(keep, pa.bool_()))

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = sorted(item_windows(words_of(text), window))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array(found, pa.binary())], ["item_id", "w"])

    return run


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int, max_windows: int, last, schema: StructType | str) -> DataFrame:
    """`docs` past every block of windows; `last` makes the result from what the last block adds."""
    scratch = Scratch(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    windows = items.mapInArrow(_windows(window), "item_id string, w binary").groupBy("w").agg(F.collect_set("item_id").alias("items"))
    windows = scratch.cut(windows)
    n = groups_for(windows.count(), max_windows)
    rows = docs.select(*(F.col(c) for c in docs.columns), *(F.lit(None).cast(t).alias(c) for c, t in _CARRIED.items()))
    for k in range(n):
        block = docs.sparkSession.sparkContext.broadcast(windows.where(F.pmod(F.xxhash64("w"), F.lit(n)) == k).toArrow())
        if k < n - 1:
            carried = scratch.cut(rows.mapInArrow(_carry(block), rows.schema))
            scratch.drop(rows)
            rows = carried
    scratch.drop(windows)
    return rows.mapInArrow(last(block), schema)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, max_windows: int = 200_000) -> DataFrame:
    """The rows of `docs` that are not contaminated, each judged by its own text; nulls, repeats and ties as above."""
    plain = docs.withColumn("text", F.col("text").cast("string"))
    return _scanned(plain, benchmark, window, max_windows, _keep, plain.schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, max_windows: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as strings, sorted), spans of the original text, contaminated.

    A document is contaminated when at least a twentieth of its words lie in benchmark windows.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _scanned(texts, benchmark, window, max_windows, _tell, RESULT)
    return found.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))
