"""Misspellings of inflected terms, run-on words and words with inner digits or marks."""

import numpy as np

from quillspark.llm import toxicity
from quillspark.llm.common import Chunk

FOUND = [("insult", True, 30, 3.0), ("insult", False, 12, 2.0), ("insults", False, 10, 2.5), ("insulting", False, 9, 2.5), ("villain", False, 8, 2.0)]


def finder():
    entries = toxicity.pruned(FOUND)
    return toxicity.Finder(entries + toxicity.below(FOUND, entries), set())


def finds(text):
    raw = text.encode()
    chunk = Chunk((0, 1), None, None, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return [(raw[a:b].decode(), w, wrong) for a, b, w, wrong in finder().finds(chunk)[0]]


def test_words_below_a_beginning_stay():
    entries = toxicity.pruned(FOUND)
    assert sorted(e[0] for e in toxicity.below(FOUND, entries)) == ["insult", "insulting", "insults"]
    assert toxicity.below(FOUND, [e for e in entries if not e[1]]) == []


def test_misspelled_forms():
    for word in ("inslt", "isnult", "insuult", "inzults", "insulling", "insutling", "ynsulted", "inslting", "villain"[:4] + "ian"):
        got = finds(f"you {word} there")
        assert got == ([] if word in ("isnult", "villian") else [(word, 3.0, True)]), word
    assert finds("an insultingly good one") == [("insultingly", 3.0, False)]
    assert finds("in sult consult result install") == []


def test_run_on_words():
    word = "insult" + "x" * 500
    assert finds(f"a {word}") == [(word, 3.0, False)]
    word = "inslt" + "é" * 500
    assert finds(f"a {word}") == [(word, 3.0, True)]
    wide = "侮辱的な言葉を使う人たちのための長い長い長い言葉です"
    raw = wide.encode()
    chunk = Chunk((0, 1), None, None, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert len(raw) > 64 and toxicity.Finder([(wide, False, 2.0)], set()).finds(chunk) == [[(0, len(raw), 2.0, False)]]


def test_inner_digits_and_marks():
    assert finds("you v1llain, vill-ain and ins*lting!") == [("v1llain", 2.0, True), ("vill-ain", 2.0, True), ("ins*lting", 3.0, True)]
    assert finds("villain-like villain.insults") == [("villain", 2.0, False), ("villain", 2.0, False), ("insults", 3.0, False)]
    assert finds("vill ain vill\nain vill--ain") == []


def test_neighbours_in_two_texts_stay_apart():
    raw = b"vill-ain"
    chunk = Chunk((0, 2), None, None, np.frombuffer(raw, np.uint8), np.array([0, 5, 8]))
    assert finder().finds(chunk) == [[], []]


def test_automaton_against_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("ab"), n)) for n in rng.integers(4, 9, 400)]
    entries = ["ababa", "bbabab", "abbbaaa"]
    trie = toxicity.Trie([(e, False, 1.0) for e in entries])
    for w in words:
        assert (trie.find(w)[0] > 0) == any(distance(w, e) <= 1 for e in entries), w


def test_marks_beyond_ascii_part_words():
    assert finds("a “villain” or «villain», a\u00a0villain\u2014no villain…") == [("villain", 2.0, False)] * 4
    raw = "so “villain” it was".encode()
    at = raw.index(b"villain")
    assert toxicity.quoted(np.frombuffer(raw, np.uint8), at, at + 7, 0, len(raw))
