"""Hierarchical multi-length packing of documents into training windows.

A document's ids (closed by `end_id`) are cut into full windows; the rest is
routed to the tier of the smallest context size that holds it.  Each tier packs
windows of its own size, longest pieces first, and fills their gaps with pieces
of shorter tiers, cutting one where none fits.  Windows of every tier are full,
so nothing is padded; what a task has left at its end goes into windows of
descending powers of two.  Windows of one tier are dealt into step groups of
`step_tokens` tokens, in snake order of their attention cost, so that steps cost alike.

Every task packs its own partition and holds at most `pool_tokens` ids of
unfinished pieces, so there is neither a shuffle nor a growing state.

Tokenising looks each pre-token up in a cache of fixed size (its hash picks the
slot, its code points are compared) and sends only those not found through the
tokenizer, each once a chunk.

Defined cases: a null or empty text is one piece holding `end_id` alone; a text that
names a special token holds its id, as the tokenizer says; a very long text is cut into
full windows and a rest; pieces of equal length are taken latest first; repeated rows are
packed repeatedly; other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import mix

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, sequence_length int, step_group bigint"
)
_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3


def _classes() -> np.ndarray:
    """Class of each code point: white space, letter, number, other."""
    table = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    for cp in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = _LETTER
        elif kind == "N":
            table[cp] = _DIGIT
    table[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return table


#: The normaliser and the split that PreTokens does by itself, as tokenizer files state them.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def parts_words(settings: dict) -> bool:
    """The tokenizer's settings are those that PreTokens can look words up for."""
    normalizer, split, model = (settings.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    first = (split.get("pretokenizers") or [{}])[0]
    added = all(t.get("special") and not t.get("normalized") for t in settings.get("added_tokens") or ())
    same = added and normalizer.get("normalizers") == NORMALIZER and first.get("pattern") == {"Regex": SPLIT} and first.get("behavior") == "Removed" and first.get("invert") is True
    return same and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not settings.get("truncation")


class PreTokens:
    """Ids of many texts at once.

    For a tokenizer that lower-cases, drops white space and parts letters, digits and the rest, words
    are looked up in the cache, where a word's hash names its slot and its code points are compared.
    Texts for any other tokenizer, and texts that hold one of its added tokens, go through it whole.
    """

    SLOTS = 1 << 20
    #: Ids and code points that the cache holds.
    FLAT, LETTERS = 6_000_000, 8_000_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        self.by_word = parts_words(settings)
        self.added = [t["content"] for t in settings.get("added_tokens") or ()]
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        for name, i in vocab.items():
            self.closes[i] = name.endswith("</w>")
        self.classes = _classes()
        self.powers = np.ones(1, np.uint64)
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(self.SLOTS, np.uint64)
        self.at = np.zeros(self.SLOTS, np.int32)
        self.size = np.zeros(self.SLOTS, np.int32)
        self.word_at = np.zeros(self.SLOTS, np.int32)
        self.word_size = np.zeros(self.SLOTS, np.int32)
        self.letters = np.zeros(self.LETTERS, np.uint32)
        self.flat = np.zeros(self.FLAT, np.uint16 if len(self.closes) <= 65536 else np.uint32)
        self.used = self.spelled = 0

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")
        return text.lower()

    def boundaries(self, cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end position of each pre-token."""
        kind = self.classes[cps]
        start = np.empty(len(cps), bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= kind == _DIGIT
        quote = np.flatnonzero((cps == 0x27) & start)
        if len(quote):  # 's 't 'm 'd 're 've 'll stand alone
            after = np.concatenate((cps, np.zeros(3, cps.dtype)))
            one, two = after[quote + 1], after[quote + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            for begins, n in ((quote[short], 2), (quote[long], 3)):
                start[begins + 1] = False
                nxt = begins + n
                start[nxt[nxt < len(cps)]] = True
        edges = np.flatnonzero(start)
        ends = np.append(edges[1:], len(cps))
        real = kind[edges] != _SPACE
        return edges[real], ends[real]

    def _hash(self, cps: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        longest = int((end - first).max())
        if len(self.powers) < longest:
            steps = np.full(max(longest, 256), 0xD6E8FEB86659FD93, np.uint64)
            steps[0] = 1
            self.powers = np.multiply.accumulate(steps)
        at = np.zeros(len(cps), np.int32)
        at[first] = first
        np.maximum.accumulate(at, out=at)
        np.subtract(np.arange(len(cps), dtype=np.int32), at, out=at)
        live = np.zeros(len(cps) + 1, np.int8)
        live[first] += 1
        live[end] -= 1
        live = np.cumsum(live[:-1], dtype=np.int8).view(bool)
        at[~live] = 0
        v = (cps + np.uint32(1)).astype(np.uint64)
        v *= np.uint64(0x9FB21C651E98DF25)
        v ^= v >> np.uint64(32)
        v *= self.powers[at]
        v[~live] = 0
        return mix(np.add.reduceat(v, first) + (end - first).astype(np.uint64)) | np.uint64(1)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each has."""
        ids = np.array(self.tok.encode(" ".join(words), add_special_tokens=False).ids, np.int64)
        last = np.flatnonzero(self.closes[ids]) if len(ids) else np.zeros(0, np.int64)
        if len(last) == len(words) and (not len(words) or last[-1] == len(ids) - 1):
            return ids, np.diff(np.concatenate(([-1], last)))
        each = [self.tok.encode(w, add_special_tokens=False).ids for w in words]
        return np.array([i for x in each for i in x], np.int64), np.array([len(x) for x in each], np.int64)

    def _known(self, h: np.ndarray, cps: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Which words stand in their slots, by hash, length and code points."""
        slot = (h >> np.uint64(44)).astype(np.int64)
        known = (self.key[slot] == h) & (self.word_size[slot] == length)
        at = np.flatnonzero(known)
        known[at[~alike(cps, first[at], self.letters, self.word_at[slot[at]], length[at])]] = False
        return known

    def _keep(self, names: np.ndarray, ids: np.ndarray, sizes: np.ndarray, cps: np.ndarray, first: np.ndarray, length: np.ndarray) -> None:
        """Puts new words into the cache, which starts anew when full; words beyond its size are not kept."""
        if len(ids) > self.FLAT or length.sum() > self.LETTERS:
            return
        if self.used + len(ids) > self.FLAT or self.spelled + length.sum() > self.LETTERS:
            self.clear()
        put = (names >> np.uint64(44)).astype(np.int64)
        self.key[put], self.size[put], self.word_size[put] = names, sizes, length
        self.at[put] = self.used + np.cumsum(sizes) - sizes
        self.word_at[put] = self.spelled + np.cumsum(length) - length
        self.flat[self.used : self.used + len(ids)] = ids
        self.letters[self.spelled : self.spelled + length.sum()] = cps[places(first, length)]
        self.used += len(ids)
        self.spelled += int(length.sum())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if not self.by_word:
            return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch(texts, add_special_tokens=False)]
        whole = {i: np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint32) for i, t in enumerate(texts) if any(a in t for a in self.added)}
        normal = ["" if i in whole else self.normal(t) for i, t in enumerate(texts)]
        joined = "\n".join(normal)
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        first, end = self.boundaries(cps) if len(cps) else (np.zeros(0, np.int64),) * 2
        if not len(first):
            return [whole.get(i, np.zeros(0, np.uint32)) for i in range(len(texts))]
        h, length = self._hash(cps, first, end), end - first
        slot = (h >> np.uint64(44)).astype(np.int64)
        known = self._known(h, cps, first, length)
        at, size, source = self.at[slot].astype(np.int64), self.size[slot], self.flat
        miss = np.flatnonzero(~known)
        if len(miss):
            names, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
            chosen = miss[where]
            # Different words of one hash: those that aren't like the first are encoded each by itself.
            same = (length[chosen][back] == length[miss]) & alike(cps, first[miss], cps, first[chosen][back], np.minimum(length[miss], length[chosen][back]))
            odd = miss[~same]
            words = [joined[a:b] for k in (chosen, odd) for a, b in zip(first[k].tolist(), end[k].tolist(), strict=True)]
            ids, sizes = self._encode(words)
            begins = self.used + np.cumsum(sizes) - sizes
            source = np.concatenate((self.flat[: self.used], ids.astype(self.flat.dtype)))
            at[miss], size[miss] = begins[back], sizes[back]
            at[odd], size[odd] = begins[len(chosen) :], sizes[len(chosen) :]
            n = int(sizes[: len(chosen)].sum())
            self._keep(names, ids[:n], sizes[: len(chosen)], cps, first[chosen], length[chosen])
        total = np.cumsum(size, dtype=np.int64)
        pick = np.repeat(at - (total - size), size) + np.arange(total[-1])
        ids = source[pick].astype(np.uint32)
        bounds = np.cumsum([0, *(len(t) + 1 for t in normal)])
        cut = np.searchsorted(first, bounds)
        ends = np.concatenate(([0], total))[cut]
        return [whole[i] if i in whole else ids[a:b] for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]


def places(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions first[i] .. first[i] + length[i] - 1 of every i, one after another."""
    before = np.cumsum(length) - length
    return np.repeat(first - before, length) + np.arange(int(length.sum()))


def alike(a: np.ndarray, a_first: np.ndarray, b: np.ndarray, b_first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which runs of `length` values of a and b are equal."""
    out = np.ones(len(length), bool)
    differ = a[places(a_first, length)] != b[places(b_first.astype(np.int64), length)]
    if differ.any():
        out[np.repeat(np.arange(len(length)), length)[differ]] = False
    return out


class Packer:
    """Packs pieces of one task; `flush` gives finished windows as rows."""

    def __init__(self, window: int, tiers: tuple[int, ...], pool_tokens: int, step_tokens: int, base: int):
        self.window, self.tiers = window, sorted({*tiers, window})
        self.pool_tokens, self.step_tokens, self.base = pool_tokens, step_tokens, base
        self.pool: dict[int, list] = {t: [] for t in self.tiers}
        self.held = self.sequences = self.steps = 0
        self.done: list[tuple[int, list]] = []
        self.open: dict[int, tuple[int, int]] = {}

    def add(self, doc, ids: np.ndarray) -> None:
        n, start = len(ids), 0
        while n - start >= self.window:
            self.done.append((self.window, [(doc, start, ids[start : start + self.window], n)]))
            start += self.window
        if start < n:
            self._route((doc, start, ids[start:], n))
        if self.held >= self.pool_tokens:
            self._pack()

    def _route(self, piece) -> None:
        size = len(piece[2])
        tier = self.tiers[bisect.bisect_left(self.tiers, size)]
        bisect.insort(self.pool[tier], piece, key=lambda p: len(p[2]))
        self.held += size

    def _take(self, tier: int, gap: int):
        """The longest piece of the tier that fits the gap."""
        row = self.pool[tier]
        k = bisect.bisect_right(row, gap, key=lambda p: len(p[2])) - 1
        if k < 0:
            return None
        self.held -= len(row[k][2])
        return row.pop(k)

    def _fill(self, size: int) -> list:
        """A full window of `size` ids; the pool must hold that many in tiers up to it."""
        out, gap = [], size
        for tier in [t for t in reversed(self.tiers) if t <= size]:
            while gap and (piece := self._take(tier, gap)):
                out.append(piece)
                gap -= len(piece[2])
        while gap:  # nothing fits: cut the shortest piece that is longer than the gap
            tier = next(t for t in self.tiers if self.pool[t])
            doc, start, ids, n = self.pool[tier].pop(0)
            self.held -= len(ids)
            part = min(gap, len(ids))
            out.append((doc, start, ids[:part], n))
            gap -= part
            if part < len(ids):
                self._route((doc, start + part, ids[part:], n))
        return out

    def _pack(self) -> None:
        for tier in reversed(self.tiers):
            below = [t for t in self.tiers if t <= tier]
            while self.pool[tier] and sum(len(p[2]) for t in below for p in self.pool[t]) >= tier and tier > self.tiers[0]:
                self.done.append((tier, self._fill(tier)))
        low = self.tiers[0]
        while sum(len(p[2]) for p in self.pool[low]) >= low:
            self.done.append((low, self._fill(low)))

    def finish(self) -> None:
        self._pack()
        while self.held:
            size = min(self.window, 1 << (self.held.bit_length() - 1))
            out, gap = [], size
            while gap:
                tier = next(t for t in reversed(self.tiers) if self.pool[t])
                doc, start, ids, n = self.pool[tier].pop()
                self.held -= len(ids)
                part = min(gap, len(ids))
                out.append((doc, start, ids[:part], n))
                gap -= part
                if part < len(ids):
                    self._route((doc, start + part, ids[part:], n))
            self.done.append((size, out))

    def flush(self):
        """Rows of the finished windows, dealt into step groups."""
        rows = []
        by_size: dict[int, list] = {}
        for size, pieces in self.done:
            by_size.setdefault(size, []).append(pieces)
        self.done = []
        for size, windows in sorted(by_size.items()):
            windows.sort(key=lambda w: -sum(len(p[2]) ** 2 for p in w))
            per = max(1, self.step_tokens // size)
            groups = -(-len(windows) // per)
            for k, pieces in enumerate(windows):
                turn, place = divmod(k, groups)
                group = self.steps + (place if turn % 2 == 0 else groups - 1 - place)
                offset = 0
                for doc, start, ids, n in pieces:
                    rows.append((doc, start, len(ids), ids, n, self.base + self.sequences, offset, size, self.base + group))
                    offset += len(ids)
                self.sequences += 1
            self.steps += groups
        return rows


_TOKENIZERS: dict[str, PreTokens] = {}


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = 2048,
    tiers: tuple[int, ...] = (256, 512, 1024),
    end_id: int = 1,
    pool_tokens: int = 1 << 18,
    step_tokens: int = 1 << 14,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset, sequence_length, step_group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _TOKENIZERS:
            _TOKENIZERS[tokenizer] = PreTokens(tokenizer)
        tok = _TOKENIZERS[tokenizer]
        packer = Packer(window, tiers, pool_tokens, step_tokens, TaskContext.get().partitionId() << 36)
        close = np.array([end_id], np.uint32)

        def rows():
            found = packer.flush()
            cols = list(zip(*found, strict=True)) if found else [[] for _ in range(9)]
            cols[3] = [x.astype("<u4").tobytes() for x in cols[3]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group"],
            )

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids):
                some, size = [], 0
                while at + len(some) < len(ids) and (not some or size < 1 << 20):
                    some.append(texts[at + len(some)].as_py() or "")
                    size += len(some[-1])
                for doc, found in zip(ids[at : at + len(some)], tok.encode(some), strict=True):
                    packer.add(doc, np.concatenate((found, close)))
                at += len(some)
                if len(packer.done) >= 512:
                    yield rows()
        packer.finish()
        yield rows()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
