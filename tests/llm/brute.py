"""The contracts said once more, as plainly as they go, for small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def lower(text):
    return text.translate(UPPER)


def jaccard(rows, n, percent):
    """[(doc_id, n_shingles, component_id)] of rows (doc_id, text)."""
    sets = []
    for _, text in rows:
        w = WORD.findall(lower(text or ""))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return [(d, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)]


ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def secrets(text):
    """(kind, start, end) of the base spans."""
    text = text or ""
    out = [(m.start(2), 0, "assign", m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    again = {j for places in at.values() if len(places) > 1 for i in places for j in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed


def windows(rows, length, units_of):
    """[(doc_id, number of units, removed flags)] of rows (doc_id, text)."""
    units = [units_of(t or "") for _, t in rows]
    inf = float("inf")
    first = {}
    for (d, _), u in zip(rows, units, strict=True):
        d = inf if d is None else d
        for i in range(len(u) - length + 1):
            k = u[i : i + length]
            first[k] = min(first.get(k, inf), d)
    out = []
    for (d, _), u in zip(rows, units, strict=True):
        me, gone = inf if d is None else d, [False] * len(u)
        for i in range(len(u) - length + 1):
            if first[u[i : i + length]] < me:
                gone[i : i + length] = [True] * length
        out.append((d, u, gone))
    return out


def suffix(rows, length=50):
    out = []
    for d, u, gone in windows(rows, length, lambda t: t.encode()):
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(u, gone, strict=True) if not g)
        out.append((d, len(u), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def substring(rows, length=13):
    out = []
    for d, u, gone in windows(rows, length, lambda t: tuple(WORD.findall(t))):
        kept = " ".join(w for w, g in zip(u, gone, strict=True) if not g)
        out.append((d, len(u), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def contamination(rows, items, window=13):
    names = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lower(text or ""))
        for i in range(max(1, len(w) - window + 1)):
            if w:
                names[tuple(w[i : i + window])].add(str(item))
    sizes = sorted({len(k) for k in names})
    out = []
    for d, text in rows:
        w = ALNUM.findall(lower(text or ""))
        hit, found = [False] * len(w), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in names:
                    hit[i : i + n] = [True] * n
                    found |= names[k]
        n = sum(hit)
        out.append((d, len(w), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0 and 20 * n >= len(w)))
    return out


def held_out(doc_id, folds, fold):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold
