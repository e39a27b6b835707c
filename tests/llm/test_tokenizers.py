"""Packing looks words up only for tokenizers whose settings it knows; ids are the tokenizer's own for any file."""

import json

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quillspark.llm.packing import PreTokens

TEXTS = ["", "Don't STOP, it's 42!", "Été — ΣΑΣ\u00a0x\t\n y", "a" * 300, "<|startoftext|> hi", "hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|startoftext|>b" * 3, "<|END<|endoftext", "< | end of text | >", "endoftext"]


def ids(path):
    tok = Tokenizer.from_file(path)
    return [tok.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_the_known_tokenizer_is_looked_up():
    path = public_tokenizers.path("word_bpe_49k.json")
    words = PreTokens(path)
    assert words.by_word and [x.tolist() for x in words.encode(TEXTS)] == ids(path)


def test_another_tokenizer_is_called(tmp_path):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        settings = json.load(f)
    settings["normalizer"] = {"type": "NFC"}
    path = str(tmp_path / "cased.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(settings, f)
    words = PreTokens(path)
    assert not words.by_word and [x.tolist() for x in words.encode(TEXTS)] == ids(path) != ids(public_tokenizers.path("word_bpe_49k.json"))


def test_words_of_one_hash_are_told_apart(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = PreTokens._hash
    monkeypatch.setattr(PreTokens, "_hash", lambda self, *a: (plain(self, *a) % np.uint64(3) << np.uint64(44)) | np.uint64(1))
    words = PreTokens(path)
    texts = [*TEXTS, "one two three four five six seven eight nine ten " * 3, "ten nine eight"]
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(3):
        assert [x.tolist() for x in words.encode(texts)] == want


def test_a_full_cache_starts_anew(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(PreTokens, "FLAT", 40)
    monkeypatch.setattr(PreTokens, "LETTERS", 120)
    words, tok = PreTokens(path), Tokenizer.from_file(path)
    for k in range(12):
        texts = [f"word{k} " + " ".join(f"w{i * k}" for i in range(k)), f"again word{k - 1} x{k}y"]
        assert [x.tolist() for x in words.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
