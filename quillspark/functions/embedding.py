"""An embedder that needs no model: words hashed into signed buckets, as unit vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quillspark.functions.slices import slices

_WORD = re.compile(r"\w+")


@lru_cache(1 << 16)
def _place(word: str, dimension: int) -> tuple[int, float]:
    """A word's bucket and sign: the first four bytes of its 64-bit BLAKE2b, and a bit of the fifth."""
    digest = hashlib.blake2b(word.encode(), digest_size=8).digest()
    return int.from_bytes(digest[:4], "big") % dimension, 1.0 if digest[4] & 1 else -1.0


def counts(text: str | None, dimension: int = 256) -> dict[int, float]:
    """The buckets that words fall into, with the sums of their signs; the first axis for text without words (or whose words cancel out)."""
    out: dict[int, float] = {}
    for word in _WORD.findall((text or "").lower()):
        at, sign = _place(word, dimension)
        out[at] = out.get(at, 0.0) + sign
    return out if any(out.values()) else {0: 1.0}


def vector(text: str | None, dimension: int = 256) -> np.ndarray:
    """A unit vector of the counts."""
    out = np.zeros(dimension)
    found = counts(text, dimension)
    out[list(found)] = list(found.values())
    return out / np.sqrt(out @ out)


def embed(texts: DataFrame, dimension: int = 256) -> DataFrame:
    """id and embedding of texts (id, text); BLAKE2 is no SQL function, so batches go through Python."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            yield pd.DataFrame({"id": frame["id"], "embedding": [vector(t, dimension) for t in frame["text"]]})

    return texts.select("id", "text").mapInPandas(run, "id bigint, embedding array<double>")
