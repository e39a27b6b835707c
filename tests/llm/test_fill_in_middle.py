"""Fill-in-the-middle against a tokenising version, and the round trip."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quillspark.llm import fill_in_middle as fim
from quillspark.llm import queries as llm

SF = "/root/testdata/sf0.001"


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = [int(x, 16) for x in re.findall("." * 8, hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest())[:4]]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    pre, mid, suf = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return doc_id, n, form, len(pre), len(mid), sha(out), sha(text)


TEXTS = [
    "", None, "a", " ", "abc", "  ", "a b", "ab, cd! 12", "P S M", "<P", "P>", "< P >", "<P>", "x<S>y", "<M> tail", "<<P>>", "a<M", "é", "éa", "aéb", "日本語 text 𝔘nicode", "\n\t\r\n", "<p>html</p> <M <S",
    "x" * 50, "?" * 50, "A1" * 40, "\x00a\x00", "a<", "<S<P<M", "¿qué? <P<", "ſK Kelvin", "PS" * 9 + "<M",
]


@pytest.fixture(scope="module")
def rows():
    out = [(i * 7 + k, t) for i, t in enumerate(TEXTS) for k in range(7)]
    out += [(None, "no id at all"), (None, None), (5, "twice"), (5, "twice"), (-3, "minus three"), (10**18, "far away, " * 20)]
    long = " ".join(f"word{i * i % 997}" for i in range(200_000))
    return [*out, (9001, long), (9002, long[: fim.PIECE - 2] + "<P>" + long), (9003, "z" * (fim.PIECE + 5)), (9004, long[: fim.PIECE - 1] + " é" + long), (9005, "é" * fim.PIECE + "a")]


def test_odd_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).withColumns({c: F.lit("clash") for c in ("n", "form", "output", "prefix_chars")})
    made = fim.transform(df).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256), F.sha2(fim.restored(), 256))
    got = sorted((tuple(r) for r in made.collect()), key=repr)
    want = sorted((brute(d, t) for d, t in rows), key=repr)
    assert got == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in llm.op13_fill_in_middle(spark, SF).collect()), key=repr) == sorted((brute(*r) for r in docs), key=repr)


def test_other_sentinels_and_no_rows(spark):
    words = ("[pre]", "{suf}", "~~"[0] + "9")
    df = spark.createDataFrame([(i, f"text{i} [pre {{suf ~8 re]uf}}") for i in range(200)], "doc_id bigint, text string")
    made = fim.transform(df, sentinels=words, plain_percent=0, spm_percent=50).withColumn("again", fim.restored(sentinels=words)).join(df, "doc_id")
    assert made.where("again <> text or form = 'plain'").count() == 0 and made.groupBy("form").count().count() == 2
    assert fim.transform(df.where("false")).collect() == []
    for bad in (("<P>", "<S>", "<P>"), ("<P<", "<S>", "<M>"), ("é1", "ab", "cd"), ("<", ">a", "]b")):
        with pytest.raises(ValueError):
            fim.transform(df, sentinels=bad)


def test_events_are_sparse_and_ranks_right():
    scanner = fim.Scanner()
    text = "Some words, é and <S numbers 123 <P"
    changes, first, marked = scanner.scan(text)
    assert not marked and first and len(changes) < len(text) // 2
    ranks, units = fim.Ranks(len(text), changes, first), re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    assert [ranks.end(i) for i in range(len(units) + 1)] == [len("".join(units[:i])) for i in range(len(units) + 1)]
