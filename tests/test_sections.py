"""Tokenizers and section chunkers against plain versions."""

import hashlib
import re

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import quillspark.plans.all  # noqa: F401
from quillspark.functions import tokens
from quillspark.operators import sections, text
from quillspark.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
PAIRS = tokens.BytePairs(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "byte_bpe_50k")
KINDS = (tokens.WORDS, tokens.Approximate(3.7), tokens.Approximate(1), tokens.Approximate(9), PAIRS)


def approximate(t, ratio):
    """Every place by trying all characters within reach."""
    reach, out, at = max(0, (int(ratio) - 1) // 2), [0] if t else [], ratio
    while at < len(t):
        near = [c for c in range(max(1, int(at) - reach), min(len(t) - 1, int(at) + reach) + 1) if reach and t[c - 1].isspace() and not t[c].isspace()]
        out.append(min(near, key=lambda c: (abs(c - int(at)), c)) if near else int(at))
        at += ratio
    return sorted(set(out) - {len(t)}) + [len(t)]


def pairs(t):
    enc = PAIRS._encoding
    assert isinstance(enc, tiktoken.Encoding)
    out, at = set(), 0
    for b in enc.decode_tokens_bytes(enc.encode_ordinary(t)):
        out.add(len(t.encode()[:at].decode(errors="ignore")))
        at += len(b)
    return sorted(out) + [len(t)]


def windows(t, size, overlap, snap, tokenizer):
    offsets = list(tokenizer.offsets(t))
    index = lambda at: max(0, max((i for i, o in enumerate(offsets) if o <= at), default=0))
    word = lambda c: c.isalnum() or c == "_"
    inside = lambda at: 0 < at < len(t) and word(t[at - 1]) and word(t[at])
    if len(offsets) - 1 <= size:
        return [t.strip()] if t.strip() else []
    out, a = [], 0
    while a < len(t):
        b = offsets[min(index(a) + size, len(offsets) - 1)]
        if b < len(t) and snap:
            for pattern in (r"\n\s*\n", r"(?<=[.!?])[\"')\]]*\s", r"\n", r"\s"):
                ends = [a + m.end() for m in re.finditer(pattern, t[a:b])]
                if ends and ends[-1] > a + int((b - a) * 0.5):
                    b = ends[-1]
                    break
        c = b
        while c > a and inside(c):
            c -= 1
        b = c if c > a else b
        if t[a:b].strip():
            out.append(t[a:b].strip())
        if b >= len(t):
            break
        n = b
        if overlap:
            n = offsets[max(0, index(b) - overlap)]
            while inside(n):
                n -= 1
        a = n if n > a else b
    return out


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é𝔘日_9 .!?\n\t\"')"), max_size=120), st.integers(1, 9), st.integers(0, 4), st.booleans(), st.sampled_from(KINDS))
def test_windows(t, size, overlap, snap, tokenizer):
    offsets = list(tokenizer.offsets(t))
    assert offsets == sorted(offsets) and offsets[-1] == len(t) and (tokenizer is tokens.WORDS or len(set(offsets)) == len(offsets))
    if isinstance(tokenizer, tokens.Approximate):
        assert offsets == approximate(t, tokenizer.ratio)
    if tokenizer is PAIRS:
        assert offsets == pairs(t)
    found = tokens.windows(t, size, overlap, snap, tokenizer)
    assert [p for _, p in found] == windows(t, size, overlap, snap, tokenizer)
    # Nothing but white space is lost, and no piece begins within a word of another.
    if not overlap:
        assert "".join("".join(p.split()) for _, p in found) == "".join(t.split())
    assert all(t[a:].lstrip().startswith(p) for a, p in found)


def test_offsets_of_documents(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {(d, k.name): list(k.offsets(t)) for d, t in docs.items() for k in (tokens.WORDS, tokens.Approximate(3.7), PAIRS)}
    for d, t in list(docs.items())[:40]:
        assert want[d, "approximate:3.7"] == approximate(t, 3.7) and (len(t) > 4000 or want[d, PAIRS.name] == pairs(t))
    got = {(r["id"], r["tokenizer"]): (r["tokens"], r["offsets_sha256"]) for r in QUERIES["token_offsets"](spark, SF).collect()}
    assert got == {k: (len(v) - 1, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for k, v in want.items()}


SECTIONS = [
    (1, 0, "A", "One two. Three four! Five?\nSix \"seven.\" Eight"), (1, 1, "A > B", "  " + "word " * 30 + "end. Short one."), (1, 2, "C", " \n\t "), (1, 3, None, None),
    (2, 0, "", "no end at all"), (3, 0, "T", "x" * 200 + ". y."), (4, 0, "D", "Dup. Dup."), (5, 0, "", "a.\n\nb. c"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(SECTIONS, "doc_id bigint, section int, title string, text string")


def listed(df):
    out = {}
    for r in df.orderBy("doc_id", "chunk_index").collect():
        out.setdefault(r["doc_id"], []).append((r["title"], r["text"], r["token_count"], r["embedded"]))
    return out


@pytest.mark.parametrize("tokenizer", [tokens.WORDS, tokens.Approximate(4)])
def test_section_chunks(rows, tokenizer):
    want = {}
    for d, _, title, t in SECTIONS:
        for p in windows((t or "").strip(), 8, 2, True, tokenizer):
            want.setdefault(d, []).append((title, p, tokens.count(tokenizer, p), p))
    assert listed(sections.by_heading(rows, 8, 2, tokenizer)) == want


@pytest.mark.parametrize("tokenizer", [tokens.WORDS, tokens.Approximate(4)])
def test_sentence_windows(rows, tokenizer):
    want = {}
    for d, _, title, t in SECTIONS:
        t, parts, at = (t or "").strip(), [], 0
        for m in re.finditer(r"(?<=[.!?])[\"')\]]*\s", t):
            parts.append(t[at : m.end()])
            at = m.end()
        parts += [t[at:]] if t[at:] else []
        for i, s in enumerate(parts):
            s = s.strip()
            if s and tokens.count(tokenizer, s) > 12:
                want.setdefault(d, []).extend((title, p, tokens.count(tokenizer, p), p) for p in windows(s, 12, 0, True, tokenizer))
            elif s:
                whole = "".join(parts[max(0, i - 1) : i + 2]).strip()
                want.setdefault(d, []).append((title, whole, tokens.count(tokenizer, whole), s))
    assert listed(sections.sentence_windows(rows, 12, 1, tokenizer)) == want


def test_whole_documents_keep_titles(rows):
    want = {}
    for d in {r[0] for r in SECTIONS}:
        parts = [(title, t.strip()) for x, _, title, t in SECTIONS if x == d and (t or "").strip()]
        joined = "\n\n".join(t for _, t in parts)
        begins = [sum(len(t) + 2 for _, t in parts[:i]) for i in range(len(parts))]
        for a, p in tokens.windows(joined, 8, 3):
            want.setdefault(d, []).append((next(parts[i][0] for i in reversed(range(len(parts))) if begins[i] <= a), p, tokens.count(tokens.WORDS, p), p))
    assert listed(sections.whole(rows, 8, 3)) == want


def test_strategies_of_texts(spark):
    docs = spark.createDataFrame([(1, "# A\none two three four.\n## B\nfive six. seven"), (2, None), (3, "")], "doc_id bigint, text string")
    assert [(t, x) for t, x, *_ in listed(text.chunk(docs, "by_heading", 50))[1]] == [("A", "# A\none two three four."), ("A > B", "## B\nfive six. seven")]
    assert [e for *_, e in listed(text.chunk(docs, "sentence_window", 50, window=1))[1]] == ["# A\none two three four.", "## B\nfive six.", "seven"]
    assert len(listed(text.chunk(docs, "fixed", 5))[1]) == 3 and set(listed(text.chunk(docs, "recursive", 5))) == {1}
    with pytest.raises(ValueError):
        text.chunk(docs, "other")
