"""Short slices of the batches that go through Python: what a worker holds depends on the slice, not on the batch."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa

#: Characters and rows of a slice; a longer text is a slice of its own.
CHARS, ROWS = 1 << 20, 1000
_LIBC = ctypes.CDLL(None)


def give_back() -> None:
    """Returns freed memory to the system, as an idle worker keeps what it once took."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def bounds(sizes: Sequence[int]) -> Iterator[tuple[int, int]]:
    """(first, end) of slices of rows that hold `sizes` characters."""
    upto, at = np.cumsum(np.asarray(sizes, np.int64)), 0
    while at < len(upto):
        before = upto[at - 1] if at else 0
        end = min(max(int(np.searchsorted(upto, before + CHARS, "right")), at + 1), at + ROWS)
        yield at, min(end, len(upto))
        at = min(end, len(upto))


def slices(frames: Iterator[pd.DataFrame], text: str = "text") -> Iterator[pd.DataFrame]:
    """The rows of `frames` in order, in slices of at most CHARS characters of `text` and ROWS rows."""
    for frame in frames:
        for at, end in bounds([len(t) if isinstance(t, str) else 0 for t in frame[text]]):
            yield frame.iloc[at:end].reset_index(drop=True)
        give_back()
