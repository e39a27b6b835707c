"""Toxicity scores from a learned lexicon, read through Levenshtein automata.

The lexicon is learned from labelled texts: words, and word beginnings of four
letters or more (an inflected stem is one entry), that stand in toxic texts and
hardly in clean ones.  It is kept as a trie.  A word is looked up by running the
Levenshtein automaton of its letters along the trie, so that an entry of five
letters or more, a word as well as a beginning, is also found with one letter
changed, missing or added (of a beginning, not its last).  Two words with one digit or mark between them are
also looked up as one misspelled word.

Each find weighs as much as its entry tells; a misspelled one less, and one in
a context window with quotation marks or a reporting word much less.  A logistic
model turns the weights of a text into its score.

Fitting uses at most about `per_class` labelled rows of each class, drawn by a
hash of doc_id, and every entry that at least `least_share` of the toxic ones among them
hold: the sample alone bounds how many those are.  Scores read whole texts and nothing but the text.

Defined cases: a null or empty text scores what no find at all scores; without
labelled rows of both classes every score is the share of toxic labels (0 without
labels); texts with the same finds have the same score; a very long text is scored whole;
repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Chunk, WordTable, in_sorted, text_chunks

_PARTS = bytes(b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122))
#: Characters beyond ASCII that part words, too: marks, blanks, signs.
_BEYOND = regex.compile(r"[^\x00-\x7F\p{L}]+")
_QUOTES = '"“”„«»‹›'
#: Words that introduce what someone else said.
_REPORTING = {"said", "says", "quote", "quoted", "quoting", "wrote", "called", "word", "term", "insult", "slur", "dit", "dijo", "sagte"}
FUZZY_LEAST = 5
MISSPELLED, QUOTED = 0.6, 0.25


class Trie:
    """Entries by letter; `exact` and `open` weights stand at their last letters."""

    def __init__(self, entries: list[tuple[str, bool, float]]):
        self.root: dict = {}
        self.depth = max((len(text) for text, _, _ in entries), default=0)
        for text, is_open, weight in entries:
            node = self.root
            for c in text:
                node = node.setdefault(c, {})
            node["open" if is_open else "exact"] = (weight, len(text))

    def find(self, word: str) -> tuple[float, bool]:
        """(best weight, whether misspelled) of the entries that the word's automaton accepts."""
        best, node = 0.0, self.root
        for k, c in enumerate(word):
            node = node.get(c)
            if node is None:
                break
            if "open" in node:
                best = max(best, node["open"][0])
            if k == len(word) - 1 and "exact" in node:
                best = max(best, node["exact"][0])
        if best:
            return best, False
        # States are edit distances to the word's beginnings one letter shorter, as long and one longer than the entry's;
        # others are above 1, and a branch without one up to 1 is cut.  No entry reaches past its length and one letter more.
        word = word[: self.depth + 2]
        n = len(word)
        stack = [(self.root, 0, 2, 0, 1)]
        while stack:
            node, d, shorter, same, longer = stack.pop()
            got = node.get("exact")
            if got and got[1] >= FUZZY_LEAST and (shorter, same, longer, 2)[min(max(n - d + 1, -1), 3)] <= 1:
                best = max(best, got[0])
            w0, w1, w2 = word[d - 1] if 0 < d <= n else None, word[d] if d < n else None, word[d + 1] if d + 1 < n else None
            for c, child in node.items():
                if len(c) != 1:
                    continue
                x = min(same + 1, shorter + (w0 != c)) if d <= n else 2
                y = min(longer + 1, same + (w1 != c), x + 1) if d < n else 2
                z = min(longer + (w2 != c), y + 1) if d + 1 < n else 2
                got = child.get("open")
                # A beginning must keep its last letter; without it, it is only a shorter one.
                if got and got[1] >= FUZZY_LEAST and ((shorter <= 1 and w0 == c) or (same <= 1 and w1 == c) or (longer <= 1 and w2 == c)):
                    best = max(best, got[0])
                if x <= 1 or y <= 1 or z <= 1:
                    stack.append((child, d + 1, x, y, z))
        return best, best > 0


def _ascii_edges(chunk: Chunk) -> Chunk:
    """The chunk with blanks, byte for byte, for what parts words beyond ASCII."""
    if not len(chunk.data) or chunk.data.max() < 128:
        return chunk
    texts = [chunk.raw(i) for i in range(len(chunk))]
    texts = [raw if raw.isascii() else _BEYOND.sub(lambda m: " " * len(m[0].encode()), raw.decode()).encode() for raw in texts]
    return Chunk(chunk.rows, chunk.ids, chunk.null, np.frombuffer(b"".join(texts), np.uint8), chunk.offsets)


class Finder:
    """Finds entries in chunks of lower-cased text; only words that could match meet the automaton."""

    def __init__(self, entries: list[tuple[str, bool, float]], skip: set[str]):
        self.trie, self.skip = Trie(entries), skip
        self.table = WordTable(_PARTS, lower=False)
        self.cache: dict[bytes, tuple[float, bool]] = {}
        # One edit leaves one half of an entry whole, at the word's same end and at a length that differs by one at most.
        ends: dict[tuple[int, int, int, int], set[int]] = {}
        inner: dict[tuple[int, int], set[int]] = {}
        for text, is_open, _ in entries:
            raw, n = text.encode(), len(text)
            if is_open and n >= FUZZY_LEAST:
                # The second half stands further on or back by the bytes of one letter.
                head, part = text[: n // 2].encode(), text[n // 2 :].encode()[:8]
                ends.setdefault((0, min(8, len(head)), len(raw) - 4, 1 << 30), set()).add(self._pack(head[:8]))
                for at in range(max(0, len(head) - 4), len(head) + 5):
                    inner.setdefault((at, len(part)), set()).add(self._pack(part))
                continue
            if is_open or n < FUZZY_LEAST:
                most = 1 << 30 if is_open else len(raw)
                ends.setdefault((0, min(8, len(raw)), len(raw), most), set()).add(self._pack(raw[:8]))
                continue
            for side, part in ((0, text[: n // 2].encode()[:8]), (1, text[n // 2 :].encode()[-8:][::-1])):
                ends.setdefault((side, len(part), len(raw) - 4, len(raw) + 4), set()).add(self._pack(part))
        self.ends = {k: np.array(sorted(v), np.uint64) for k, v in ends.items()}
        self.inner = {k: np.array(sorted(v), np.uint64) for k, v in inner.items()}

    @staticmethod
    def _pack(raw: bytes) -> int:
        return int.from_bytes(raw.ljust(8, b"\0"), "big")

    def _edges(self, data: np.ndarray, at: np.ndarray, step: int, size: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for k in range(8):
            live = size > k
            b = np.zeros(len(at), np.uint64)
            b[live] = data[at[live] + step * k]
            out |= b << np.uint64(56 - 8 * k)
        return out

    def finds(self, chunk: Chunk) -> list[list[tuple[int, int, float, bool]]]:
        """(first byte, end byte, weight, misspelled) of each find of each text."""
        out: list[list] = [[] for _ in range(len(chunk))]
        names, starts, stops, firsts = self.table.words(_ascii_edges(chunk))
        if not len(starts):
            return out
        # Each different word is looked up once.
        _, one, which = np.unique(names, return_index=True, return_inverse=True)
        got = self._look_up(chunk.data, starts[one], stops[one])
        weight, wrong = got[0][which], got[1][which]
        found = np.flatnonzero(weight)
        rows = [found], [starts[found]], [stops[found]], [weight[found]], [wrong[found]]
        # Neighbours with one digit or mark between them, neither of them a find.
        near = np.flatnonzero((starts[1:] == stops[:-1] + 1) & (weight[:-1] == 0) & (weight[1:] == 0))
        mark = chunk.data[stops[near]]
        near = near[(mark > 32) & (mark < 127) & ~np.isin(near + 1, firsts)]
        if len(near):
            got = self._look_up(chunk.data, starts[near], stops[near + 1])
            kept = np.flatnonzero(got[0])
            for row, more in zip(rows, (near[kept], starts[near[kept]], stops[near[kept] + 1], got[0][kept], got[1][kept]), strict=True):
                row.append(more)
        at, first, end, weight, wrong = map(np.concatenate, rows)
        order = np.argsort(at, kind="stable")
        doc = np.searchsorted(firsts, at, side="right") - 1
        for d, *find in zip(*(x[order].tolist() for x in (doc, first, end, weight, wrong)), strict=True):
            out[d].append(tuple(find))
        return out

    def _look_up(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight (0 for none) of each word, and whether it is misspelled."""
        size = stops - starts
        maybe = np.zeros(len(starts), bool)
        packed = [self._edges(data, starts, 1, size), self._edges(data, stops - 1, -1, size)]
        for (side, k, least, most), table in self.ends.items():
            maybe |= (size >= max(k, least)) & (size <= most) & in_sorted(table, packed[side] & self._mask(k))
        further = {at: self._edges(data, starts + at, 1, size - at) for at in {at for at, _ in self.inner}}
        for (at, k), table in self.inner.items():
            maybe |= (size >= at + k) & in_sorted(table, further[at] & self._mask(k))
        weight, wrong = np.zeros(len(starts)), np.zeros(len(starts), bool)
        for i in np.flatnonzero(maybe).tolist():
            raw = data[starts[i] : stops[i]].tobytes()
            got = self.cache.get(raw)
            if got is None:
                if len(self.cache) > 200_000:
                    self.cache.clear()
                word = raw.decode("utf-8", "replace")
                got = self.trie.find(word)
                if got[1] and word in self.skip:
                    got = (0.0, False)
                if len(raw) <= 64:
                    self.cache[raw] = got
            weight[i], wrong[i] = got
        return weight, wrong

    @staticmethod
    def _mask(k: int) -> np.uint64:
        return np.uint64(((1 << 8 * k) - 1) << (64 - 8 * k))


def quoted(data: np.ndarray, a: int, b: int, low: int, high: int, reach: int = 40) -> bool:
    """Whether the context window says that the word is cited."""
    left = data[max(low, a - reach) : a].tobytes().decode("utf-8", "ignore")
    right = data[b : min(high, b + reach)].tobytes().decode("utf-8", "ignore")
    if any(c in _QUOTES for c in left) and any(c in _QUOTES for c in right):
        return True
    near = re.findall(r"[^\W\d_]+", left)[-3:]
    return bool(set(near) & _REPORTING) or left.rpartition("\n")[2].lstrip().startswith(">")


def lowered(chunk: Chunk) -> Chunk:
    texts = [chunk.raw(i).decode().lower().encode() for i in range(len(chunk))]
    offsets = np.cumsum([0, *map(len, texts)])
    return Chunk(chunk.rows, chunk.ids, chunk.null, np.frombuffer(b"".join(texts), np.uint8), offsets)


def measured(finder: Finder, chunk: Chunk) -> np.ndarray:
    """Features of each text: weight found, different entries found, weight a word."""
    low = lowered(chunk)
    out = np.zeros((len(chunk), 3))
    spaces = np.concatenate(([0], np.cumsum(low.data == 32)))
    for i, finds in enumerate(finder.finds(low)):
        if not finds:
            continue
        begin, end = int(low.offsets[i]), int(low.offsets[i + 1])
        total, kinds = 0.0, set()
        for a, b, weight, wrong in finds:
            weight *= MISSPELLED if wrong else 1.0
            if quoted(low.data, a, b, begin, end):
                weight *= QUOTED
            else:
                kinds.add(low.data[a:b].tobytes())
            total += weight
        n = 1 + int(spaces[end] - spaces[begin])
        out[i] = np.log1p(total), np.log1p(len(kinds)), 100 * total / n / (1 + 100 * total / n)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 2e-5) -> np.ndarray:
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    ridge = np.diag([l2] * (x1.shape[1] - 1) + [1e-6]) * len(x)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        h = (x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + ridge
        w -= np.linalg.solve(h, x1.T @ (p - y) + ridge @ w)
    return w


def _entries(sample: DataFrame, least: int) -> list[tuple[str, bool, float]]:
    """Words and beginnings with their weights.

    A word counts once for each text that owns one of its contexts (the words
    around it), the text with the smallest id; copies of a text so add nothing.
    """
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")
    at = sample.select("doc_id", "toxic", words.alias("w")).select("doc_id", "toxic", "w", F.posexplode("w").alias("i", "word"))
    near = F.xxhash64(F.get("w", F.col("i") - 1), F.get("w", F.col("i") + 1))
    owned = (
        at.where(F.length("word") >= 3)
        .select("word", near.alias("near"), F.struct("doc_id", "toxic").alias("owner"))
        .groupBy("word", "near")
        .agg(F.min("owner").alias("owner"))
        .select("word", "owner.doc_id", "owner.toxic")
        .distinct()
    )
    keys = F.concat(
        F.array(F.struct(F.col("word").alias("entry"), F.lit(False).alias("open"))),
        F.transform(F.expr("sequence(4, greatest(4, least(7, length(word))))"), lambda k: F.struct(F.substring(F.col("word"), F.lit(1), k).alias("entry"), F.lit(True).alias("open"))),
    )
    counts = (
        owned.select("doc_id", "toxic", F.explode(keys).alias("k"))
        .where(F.expr("not k.open or length(k.entry) >= 4"))
        .select("doc_id", "toxic", "k.entry", "k.open")
        .distinct()
        .groupBy("entry", "open")
        .agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good"))
        .where((F.col("bad") >= least) & (F.col("bad") >= 12 * F.col("good")))
        .orderBy(F.desc("bad"), "entry", "open")
        .collect()
    )
    found = [(r["entry"], r["open"], r["bad"], float(np.log((r["bad"] + 0.5) / (r["good"] + 0.5)))) for r in counts]
    entries = pruned(found)
    return entries + below(found, entries)


def pruned(found: list[tuple[str, bool, int, float]]) -> list[tuple[str, bool, float]]:
    """Entries that say something of their own.

    A beginning goes if one word or one longer beginning accounts for nearly all of it;
    what stands below a beginning that stays goes too.
    """
    by_words = {}
    by_stems = {}
    for text, is_open, bad, _ in found:
        for k in range(4, len(text) + (not is_open)):
            book = by_stems if is_open else by_words
            book[text[:k]] = max(bad, book.get(text[:k], 0))
    stems = {
        text for text, is_open, bad, _ in found if is_open and bad > 1.25 * by_words.get(text, 0) and bad > 1.1 * by_stems.get(text, 0)
    }
    return [
        (text, is_open, weight)
        for text, is_open, _, weight in found
        if (not is_open or text in stems) and not any(text[:k] in stems for k in range(4, len(text) + (not is_open)))
    ]


def below(found: list[tuple[str, bool, int, float]], entries: list[tuple[str, bool, float]]) -> list[tuple[str, bool, float]]:
    """The whole words at and below the beginnings among `entries`: their misspellings count as well."""
    stems = {text: weight for text, is_open, weight in entries if is_open}
    out = []
    for text, is_open, _, _ in found:
        weights = [stems[text[:k]] for k in range(4, len(text) + 1) if text[:k] in stems]
        if weights and not is_open:
            out.append((text, False, max(weights)))  # the word itself stays a find of its beginning
    return out


def fit(
    docs: DataFrame, labels: DataFrame, train: Column, per_class: int = 1500, least_share: float = 0.01
) -> dict:
    """A model from labelled rows where `train` (an expression over doc_id) holds."""
    marked = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(train & F.col("toxic").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    counts = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    none = {"entries": [], "skip": set(), "w": None, "prior": prior}
    if len(counts) < 2:
        return none
    draw = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = F.when(F.col("toxic") == 1, F.lit(per_class / counts[1])).otherwise(F.lit(per_class / counts[0]))
    chosen = marked.where(draw < share)  # about 2 * per_class rows: a bounded broadcast
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = sample.where("text is not null").repartition(8).persist()
    toxic = sample.where("toxic = 1").count()
    entries = _entries(sample, max(3, int(least_share * toxic)))
    if not entries:
        sample.unpersist()
        return none
    shared = sample.sparkSession.sparkContext.broadcast(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value, set())
        for batch in batches:
            toxic = batch.column(2)
            for chunk in text_chunks(batch):
                x = measured(finder, chunk)
                wrong = [sorted({low.data[a:b].tobytes().decode() for a, b, _, m in f if m}) for low in [lowered(chunk)] for f in finder.finds(low)]
                yield pa.RecordBatch.from_arrays(
                    [toxic.slice(chunk.rows[0], len(chunk)), pa.array(list(x), pa.list_(pa.float64())), pa.array(wrong, pa.list_(pa.string()))],
                    ["toxic", "x", "wrong"],
                )

    rows = sample.select("doc_id", "text", "toxic").mapInArrow(run, "toxic int, x array<double>, wrong array<string>").collect()
    sample.unpersist()
    y = np.array([r["toxic"] for r in rows], float)
    # A misspelling that clean texts have is a word of its own.
    skip = {w for r in rows if not r["toxic"] for w in r["wrong"]}
    w = _logistic(np.array([r["x"] for r in rows]), y)
    drawn = y.mean()
    w[-1] += np.log(prior / (1 - prior)) - np.log(drawn / (1 - drawn)) if 0 < drawn < 1 else 0.0
    return {"entries": entries, "skip": skip, "w": w, "prior": prior}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, and the finds (term, misspelled, quoted is weighed in) of every row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        finder = Finder(m["entries"], m["skip"])
        for batch in batches:
            for chunk in text_chunks(batch):
                if m["w"] is None:
                    p = np.full(len(chunk), m["prior"])
                else:
                    z = np.hstack([measured(finder, chunk), np.ones((len(chunk), 1))]) @ m["w"]
                    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([chunk.ids, pa.array(p, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, score double"
    )
