"""Fill-in-the-middle by an Aho-Corasick event scan.

Units of a text are runs of the letters A-Z and a-z, and single characters of any
other kind.  One automaton holds every pair of neighbours that changes class (letter
and other) and the sentinels; it runs over the text with each character that no
sentinel has folded to one letter or one other ASCII character.  Its events part the
text into gaps of one class: a gap of letters is one unit and any other gap as many
as it has characters, so the events' running sums alone give the number of units and
the place at which the unit of any rank ends.

Where the cuts fall is drawn from the hash of seed and doc_id; see `transform`.

Defined cases: a null text counts as empty, and an empty text stays plain; a null
doc_id draws from the seed alone; repeated rows give repeated results; other columns
are ignored.  Very long texts are scanned in pieces, with results as for the whole.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINELS = ("<P>", "<S>", "<M>")
#: Characters scanned at a time, and bytes of output in a batch.
PIECE, BATCH_BYTES = 1 << 20, 4 << 20
RESULT = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
_LETTERS = frozenset(string.ascii_letters.encode())
_CHANGE, _SENTINEL = 1, 2


class Scanner:
    """Class changes and sentinels of texts, by one automaton."""

    def __init__(self, sentinels: tuple[str, str, str] = SENTINELS):
        marks = set("".join(sentinels))
        heads = {s[0] for s in sentinels}
        if not all(s.isascii() and len(s) > 1 for s in sentinels) or len(set(sentinels)) < 3 or any(c in heads for s in sentinels for c in s[1:]):
            raise ValueError("sentinels are distinct ASCII strings whose first characters stand nowhere else in them")
        letters = {c for c in marks if ord(c) in _LETTERS}
        # One letter and one other character stand for all those that no sentinel has.
        letter = next(chr(b) for b in sorted(_LETTERS) if chr(b) not in marks)
        other = next(chr(b) for b in range(32, 127) if chr(b) not in marks and b not in _LETTERS)
        self.fold = bytes(b if chr(b) in marks else ord(letter if b in _LETTERS else other) for b in range(256))
        self.longest = max(map(len, sentinels))
        self.auto = ahocorasick.Automaton()
        pairs = {x + y for a in letters | {letter} for b in marks - letters | {other} for x, y in ((a, b), (b, a))}
        for word in sorted(pairs.union(sentinels)):
            self.auto.add_word(word, _CHANGE * (word in pairs) | _SENTINEL * (word in sentinels))
        self.auto.make_automaton()

    def scan(self, text: str) -> tuple[np.ndarray, bool, bool]:
        """Where the class changes, in code points; whether the text starts with a letter; whether it holds a sentinel."""
        # Every code point beyond ASCII is one character of the other class.
        folded = text.encode("ascii", "replace").translate(self.fold).decode("ascii")
        found, marked = [np.zeros(0, np.int64)], False
        for at in range(0, len(folded), PIECE):
            # What is ahead completes a match that starts in this piece.
            piece = folded[at : at + PIECE + self.longest - 1]
            ends, kinds = np.fromiter(self.auto.iter(piece), np.dtype((np.int64, 2))).reshape(-1, 2).T
            marked = marked or bool((kinds & _SENTINEL).any())
            ends = ends[(kinds & _CHANGE) > 0]
            found.append(ends[ends <= PIECE] + at)
        return np.concatenate(found), bool(text) and text[0].isascii() and text[0].isalpha(), marked


class Ranks:
    """Units of a text from the places where its class changes."""

    def __init__(self, length: int, changes: np.ndarray, letter_first: bool):
        self.edges = np.concatenate(([0], changes, [length])).astype(np.int64)
        sizes = np.diff(self.edges)
        letters = (np.arange(len(sizes)) % 2 == 0) == letter_first
        units = np.where(letters & (sizes > 0), 1, sizes)
        self.upto = np.concatenate(([0], np.cumsum(units)))
        self.letters = letters
        self.n = int(self.upto[-1])

    def end(self, rank: int) -> int:
        """Code points of the first `rank` units."""
        if rank <= 0:
            return 0
        gap = int(np.searchsorted(self.upto, rank)) - 1
        return int(self.edges[gap + 1] if self.letters[gap] else self.edges[gap] + rank - self.upto[gap])


def draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def transform(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every document.

    Of four 32-bit draws, the first two choose the cuts among the n + 1 places between units; a document is
    plain if it is empty, holds a sentinel, or the third draw is in the last `plain_percent` of a hundred; else
    spm (suffix first) if the fourth is in the first `spm_percent`, or psm.
    """
    Scanner(sentinels)  # raises here what would be raised in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, (p, s, m) = Scanner(sentinels), sentinels
        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                doc_id, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or ""
                h1, h2, h3, h4 = draws(doc_id, seed)
                changes, letter_first, marked = scanner.scan(text)
                ranks = Ranks(len(text), changes, letter_first)
                n = ranks.n
                if not text or marked or h3 % 100 >= 100 - plain_percent:
                    rows.append((doc_id, n, "plain", None, None, text))
                else:
                    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                    a, b = ranks.end(a), ranks.end(b)
                    prefix, middle, suffix = text[:a], text[a:b], text[b:]
                    form = "spm" if h4 % 100 < spm_percent else "psm"
                    output = f"{s}{suffix}{p}{prefix}{m}{middle}" if form == "spm" else f"{p}{prefix}{s}{suffix}{m}{middle}"
                    rows.append((doc_id, n, form, a, b - a, output))
                size += len(text)
                if size > BATCH_BYTES or i == batch.num_rows - 1:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], RESULT.replace(",", "").split()[::2])
                    rows, size = [], 0

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)


def restored(output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text again, from output and form alone: no sentinel stands in a text that was cut, nor across a seam."""
    p, s, m = sentinels

    def between(first: str, second: str) -> tuple[str, str, str]:
        """What follows `first` at the head, what follows `second`, and what follows `m`."""
        at, to = f"locate('{second}', {output})", f"locate('{m}', {output})"
        cut = lambda a, size, b: f"substring({output}, {a} + {size}, {b} - {a} - {size})"
        return cut("1", len(first), at), cut(at, len(second), to), f"substring({output}, {to} + {len(m)})"

    prefix, suffix, middle = between(p, s)
    later, early, mid = between(s, p)
    return F.expr(f"case {form} when 'psm' then concat({prefix}, {middle}, {suffix}) when 'spm' then concat({early}, {mid}, {later}) else {output} end")


#: The contract in SQL.
SQL = """
with t as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u,
    sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h
  from documents
), d as (
  select doc_id, t, u, cast(len(u) as bigint) as n,
    cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4
  from t
), c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from d
), p as (
  select *, coalesce(array_to_string(u[1:a], ''), '') as pre, coalesce(array_to_string(u[a + 1:b], ''), '') as mid, coalesce(array_to_string(u[b + 1:], ''), '') as suf from c
)
select doc_id, n, form,
  case when form <> 'plain' then cast(length(pre) as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(length(mid) as bigint) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(t) as restored_sha256
from p
"""
