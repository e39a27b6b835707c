"""The registered queries over whole tables, against brute force, round trips or held-out figures."""

import hashlib
import json
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quillspark.llm import queries as llm
from tests.llm import brute
from tests.oracle import both

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_ngram_jaccard(spark, docs):
    got = rows(llm.op1_ngram_jaccard(spark, SF), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute.jaccard(docs, 4, 85), key=repr)


def test_secret_scan(spark, docs):
    got = rows(llm.op2_secret_scan(spark, SF), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    want = []
    for d, text in docs:
        found = brute.secrets(text)
        n = [sum(k == kind for k, _, _ in found) for kind in ("assign", "access", "hex")]
        want.append((d, *n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_secret_scan_gives_the_spans_of_matches(spark, tmp_path):
    """The name before a secret is in its span and sets its place; the secret alone decides whether it counts."""
    key, digits = "AKIA" + "B" * 16, "0f" * 12
    texts = {
        1: ("é token = \"abcdef1\" x", "assign:2:18"),
        2: (f"passwd:{digits} {key}", "assign:0:31,hex:7:31,access:32:52"),
        3: (f"{digits}secret:{key}", "hex:0:24,assign:24:51,access:31:51"),
        4: ("token=abcde API_KEY':  '𝔘 api_key: /+.-=_", "assign:26:41"),
        5: ("token" * 9 + "=abcdef" + " Secret=abcdef" * 70, ",".join(f"assign:{a}:{b}" for a, b in [(40, 52)] + [(53 + 14 * k, 66 + 14 * k) for k in range(70)])),
        6: (None, ""),
    }
    spark.createDataFrame([(d, t) for d, (t, _) in texts.items()], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = rows(llm.op2_secret_scan(spark, str(tmp_path)), "doc_id", "spans", "base_sha256")
    assert got == [(d, s, hashlib.sha256(s.encode()).hexdigest()) for d, (_, s) in texts.items()]


def test_quality_rules(spark, docs):
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows(llm.op3_quality_rules(spark, SF), *cols) == sorted(((d, *brute.quality(t)) for d, t in docs), key=repr)


def test_suffix_dedup(spark, docs):
    got = rows(llm.op4_suffix_dedup(spark, SF), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.suffix(docs), key=repr)


def test_substring_dedup(spark, docs):
    got = rows(llm.op5_substring_dedup(spark, SF), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.substring(docs), key=repr)


def assert_packed(pieces, docs, window=2048):
    """pieces: dicts of op6's columns. Every id of every document lies in one piece, and sequences have no gaps."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    for d, text in docs:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids))
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    padded = used = 0
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        used += at
        padded += at if at & (at - 1) == 0 else window
    assert used >= 0.97 * padded


def test_packing(spark, docs):
    assert_packed([r.asDict() for r in llm.op6_packing(spark, SF).collect()], docs)


def test_decontamination(spark, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = rows(llm.op7_decontamination(spark, SF), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = sorted(brute.contamination(docs, items), key=repr)
    assert got == want
    assert any(r[-1] for r in want)


def test_language_id_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = llm.op8_language_id(spark, sf).collect()
    assert len(got) == len(langs) and all(r["held_out"] == brute.held_out(r["doc_id"], 5, 0) for r in got)
    told = [r for r in got if r["held_out"] and langs[r["doc_id"]] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in told) >= 0.95 * len(told) and len(told) > 100
    assert all(0 <= r["score"] <= 1 for r in got)


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = llm.op10_toxicity(spark, sf).collect()
    assert all(r["held_out"] == brute.held_out(r["doc_id"], 4, 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    told = [(r["score"], toxic[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in toxic]
    bad, good = [s for s, t in told if t == 1], [s for s, t in told if t == 0]
    auc = np.mean([[(b > g) + 0.5 * (b == g) for g in good] for b in bad])
    # So few labels (14 toxic ones held out) teach a part of the lexicon only; over 0.1 GB it is 0.99 and more.
    assert auc >= 0.8, (auc, len(bad), len(good))


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_sql(spark, name):
    mine, theirs = both(spark, llm.QUERIES[name], llm.SQL[name], SF)
    assert mine[0] == theirs[0]
    assert json.dumps(mine[1], default=str) == json.dumps(theirs[1], default=str)
