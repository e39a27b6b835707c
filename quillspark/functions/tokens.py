"""Tokenizers as one port: the places where a text's tokens begin, and windows of tokens cut from it.

Whatever counts or cuts tokens takes a tokenizer, that is, anything with a `name` and `offsets(text)`: where each
token begins, in code points and rising, and then the text's length.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cached_property
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.slices import bounds, give_back


class Tokenizer(Protocol):
    name: str

    def offsets(self, text: str) -> np.ndarray: ...


class Words:
    """Runs of letters, digits and _, and every other mark that isn't white space."""

    name = "words"
    _TOKEN = re.compile(r"\w+|[^\w\s]")

    def offsets(self, text: str) -> np.ndarray:
        return np.array([*(m.start() for m in self._TOKEN.finditer(text)), len(text)], np.int64)


class Approximate:
    """A token every `ratio` characters, moved to the nearest start of a word if one is closer than half a token.

    Less than half a token, so that no two places meet and the number of tokens depends on the length alone; of two word
    starts at equal distance the earlier one is taken.
    """

    def __init__(self, ratio: float):
        if not ratio >= 1:
            raise ValueError("a token has one character at least")
        self.ratio = float(ratio)
        self.name = f"approximate:{self.ratio:g}"
        self.reach = max(0, (int(self.ratio) - 1) // 2)

    def offsets(self, text: str) -> np.ndarray:
        n = len(text)
        if not n:
            return np.zeros(1, np.int64)
        ideal = np.add.accumulate(np.full(int(n / self.ratio) + 1, self.ratio))
        ideal = ideal[ideal < n].astype(np.int64)
        starts = np.array([m.end() for m in re.finditer(r"\s(?=\S)", text)], np.int64)
        if self.reach and len(starts) and len(ideal):
            right = np.minimum(np.searchsorted(starts, ideal), len(starts) - 1)
            left = np.maximum(right - 1, 0)
            near = np.where(np.abs(starts[left] - ideal) <= np.abs(starts[right] - ideal), starts[left], starts[right])
            ideal = np.where(np.abs(near - ideal) <= self.reach, near, ideal)
        return np.unique(np.concatenate(([0], ideal, [n])))


class BytePairs:
    """Tokens of a byte-pair vocabulary of ranks; the file, whose path is a parameter, is read once a process."""

    def __init__(self, path: str, pattern: str, name: str = "byte pairs"):
        self.path, self.pattern, self.name = path, pattern, name

    def __getstate__(self):
        return {"path": self.path, "pattern": self.pattern, "name": self.name}

    @cached_property
    def _encoding(self):
        import tiktoken

        with open(self.path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding(self.name, pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})

    def offsets(self, text: str) -> np.ndarray:
        """A token that begins within a character is one with the token before it."""
        if not text:
            return np.zeros(1, np.int64)
        sizes = [len(b) for b in self._encoding.decode_tokens_bytes(self._encoding.encode_ordinary(text))]
        data = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        return np.append(np.unique(character[np.cumsum([0, *sizes[:-1]])]), len(text))


WORDS = Words()
#: Ends of paragraphs, sentences, lines and words, the best first, and the share of a window that a piece must fill to end at one.
SEPARATORS = tuple(map(re.compile, (r"\n\s*\n", r"(?<=[.!?])[\"')\]]*\s", r"\n", r"\s")))
LEAST_SHARE = 0.5


def count(tokenizer: Tokenizer, text: str) -> int:
    return len(tokenizer.offsets(text)) - 1


def _joins_word(text: str, at: int) -> bool:
    """A cut here would part a word."""
    return 0 < at < len(text) and all(c.isalnum() or c == "_" for c in text[at - 1 : at + 1])


def _word_begin(text: str, at: int, least: int = 0) -> int:
    while at > least and _joins_word(text, at):
        at -= 1
    return at


def windows(text: str, size: int, overlap: int = 0, snap: bool = True, tokenizer: Tokenizer = WORDS, offsets: np.ndarray | None = None) -> list[tuple[int, str]]:
    """(start, piece) of windows of at most `size` tokens of a text, trimmed; blank ones are left out.

    A piece ends at the last paragraph, sentence, line or word end in the second half of its window (with `snap`), and never
    within a word, if the word doesn't fill the window; the next one begins `overlap` tokens before that, at the start of a word.
    `offsets` are the text's, where they are known.
    """
    offsets = tokenizer.offsets(text) if offsets is None else offsets
    last = len(offsets) - 1
    if last <= size:
        return [(0, text.strip())] if text.strip() else []

    def step(at: int, tokens: int) -> int:
        return int(offsets[min(max(max(0, int(np.searchsorted(offsets, at, "right")) - 1) + tokens, 0), last)])

    out, start = [], 0
    while start < len(text):
        end = step(start, size)
        if end < len(text):
            if snap:
                least = start + int((end - start) * LEAST_SHARE)
                ends = (max((m.end() for m in s.finditer(text, start, end)), default=0) for s in SEPARATORS)
                end = next((e for e in ends if e > least), end)
            whole = _word_begin(text, end, start)
            end = whole if whole > start else end
        if piece := text[start:end].strip():
            out.append((start, piece))
        if end >= len(text):
            break
        begin = _word_begin(text, step(end, -overlap)) if overlap > 0 else end
        start = begin if begin > start else end
    return out


def token_offsets(texts: DataFrame, tokenizer: Tokenizer, id_col: str = "id") -> DataFrame:
    """id and offsets of texts (id, text); a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in bounds(pc.fill_null(pc.binary_length(batch.column(1)), 0)):
                part = batch.slice(at, end - at)
                rows = [tokenizer.offsets(t or "").astype(np.int32) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.int32()))], ["id", "offsets"])
            give_back()

    return texts.select(F.col(id_col).cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "id bigint, offsets array<int>")
