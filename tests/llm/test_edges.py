"""Nulls, empty and very long texts, ties, repeated rows, empty tables, and columns with clashing names."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import (
    decontamination,
    language_id,
    license_scan,
    ngram_jaccard,
    packing,
    quality_rules,
    secret_scan,
    substring_dedup,
    suffix_dedup,
    toxicity,
)
from tests.llm import brute
from tests.llm.test_queries import assert_packed

CLASH = "node t k m blob findings w lines good kept n n_words word text_ root run rank part spans items score start end toxic".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i * i % 9973} w{i % 811}" for i in range(60_000))
PASSAGE = " ".join(f"passage{i}" for i in range(80))
ROWS = [
    (1, "", "en", "web", 0),
    (2, None, None, None, None),
    (3, " \t\n ", "en", "web", 4),
    (4, LONG, "en", "web", len(LONG)),
    (5, LONG + " tail", "de", "web", len(LONG) + 5),
    (6, PASSAGE, "en", "hot", len(PASSAGE)),
    (7, "ahead " + PASSAGE + " behind\nand on", "en", "hot", 10),
    (None, PASSAGE.upper(), "fr", "hot", 10),
    (None, PASSAGE, "fr", None, 10),
    (8, PASSAGE.replace("passage40", "other"), "en", "hot", None),
    (6, PASSAGE, "en", "hot", len(PASSAGE)),
    (9, "eins zwei", "de", "web", 9),
    (9, "Eins  Zwei", "de", "web", 9),
    (10, "é" * 70 + "日本" * 40 + " 𝔘nicode", None, "web", 9),
    (11, "x " * 300, "en", "web", 9),
    (12, "y\tx " + "x " * 200 + "z", "en", "web", 9),
    (13, 'token="abcdef123456" token=abc AKIA' + "B" * 20 + " " + "0f" * 15, "en", "web", 9),
]


def table(spark, rows, clash=True):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASH}) if clash else df


def plain(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


PAIRS = [(d, t) for d, t, *_ in ROWS]


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_jaccard(spark, n, percent):
    got = plain(ngram_jaccard.join(table(spark, ROWS), n, percent), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute.jaccard(PAIRS, n, percent), key=repr)


def test_jaccard_of_short_sets(spark):
    base = [f"w{i}" for i in range(40)]
    rows = []
    for k in range(1, 40):
        rows += [(len(rows) + j, " ".join(base[a:b])) for j, (a, b) in enumerate(((0, k), (0, k + 1), (k % 3, k + 2), (1, k)))]
    got = plain(ngram_jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 85), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute.jaccard(rows, 4, 85), key=repr)


def test_jaccard_chains_within_a_common_part(spark):
    """Very many sets share parts; links between members that aren't first in a run still join components."""
    base = [f"b{i}" for i in range(60)]
    rows = []
    for k in range(150):
        w = list(base)
        for j in range(1 + k % 5):
            w[(7 * k + 11 * j) % 60] = f"c{k}_{j}"
        rows.append((k, " ".join(w)))
    got = plain(ngram_jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2), 4, 85), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute.jaccard(rows, 4, 85), key=repr)


def test_suffix(spark):
    out = suffix_dedup.deduplicate(table(spark, ROWS)).withColumn("sha", F.sha2("kept", 256))
    assert plain(out, "doc_id", "n_bytes", "n_removed", "n_spans", "sha") == sorted(brute.suffix(PAIRS), key=repr)


def test_substring(spark):
    out = substring_dedup.deduplicate(table(spark, ROWS)).withColumn("sha", F.sha2("kept", 256))
    assert plain(out, "doc_id", "n_words", "n_removed", "sha") == sorted(brute.substring(PAIRS), key=repr)


def test_common_windows(spark):
    """One passage in very many documents, with other surroundings each time."""
    rows = [(k, f"s{k} t{k} " + PASSAGE[: 300 + k] + f" u{k} " + "z " * 40 + f"v{k}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    a = suffix_dedup.deduplicate(docs).withColumn("sha", F.sha2("kept", 256))
    assert plain(a, "doc_id", "n_bytes", "n_removed", "n_spans", "sha") == sorted(brute.suffix(rows), key=repr)
    b = substring_dedup.deduplicate(docs).withColumn("sha", F.sha2("kept", 256))
    assert plain(b, "doc_id", "n_words", "n_removed", "sha") == sorted(brute.substring(rows), key=repr)


def test_windows_of_very_common_digits(spark):
    """Open runs sent window by window, and windows longer than may be."""
    rows = [(k, f"s{k} t{k} " + PASSAGE[: 200 + k] + f" u{k % 7} " + "z " * 20 + f"v{k}") for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1)
    a = suffix_dedup.deduplicate(docs).withColumn("sha", F.sha2("kept", 256))
    assert plain(a, "doc_id", "n_bytes", "n_removed", "n_spans", "sha") == sorted(brute.suffix(rows), key=repr)
    b = substring_dedup.deduplicate(docs).withColumn("sha", F.sha2("kept", 256))
    assert plain(b, "doc_id", "n_words", "n_removed", "sha") == sorted(brute.substring(rows), key=repr)
    with pytest.raises(ValueError):
        suffix_dedup.deduplicate(docs, 65)


def test_one_row_of_each_group(spark):
    rows = [(6, PASSAGE), (6, PASSAGE), (6, "quite other words"), (None, PASSAGE), (None, PASSAGE.upper()), (None, "lone words here"), (None, "lone words here"), (9, ""), (9, ""), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", k) for k, (d, t) in enumerate(rows)], "doc_id bigint, text string, lang string, k int").repartition(3)
    got = plain(ngram_jaccard.one_of_each(docs), "doc_id", "text")
    assert got == sorted([(6, PASSAGE), (6, "quite other words"), (None, "lone words here"), (9, ""), (9, ""), (None, None)], key=repr)
    assert ngram_jaccard.one_of_each(docs).columns == docs.columns


def test_components_of_many_shares(spark, tmp_path):
    from quillspark.llm.common import Scratch
    from quillspark.llm.components import components

    edges = [(k, k + 7) for k in range(0, 700, 7)] + [(3000 - k, 3001 - k) for k in range(200)] + [(5, 9000 + k) for k in range(300)] + [(1, 1)]
    links = spark.createDataFrame(edges, "a bigint, b bigint").repartition(4)
    outs = [plain(components(links, Scratch(spark), share), "node", "root") for share in (1 << 20, 50)]
    assert outs[0] == outs[1] and {r for _, r in outs[0]} == {0, 2801, 5} and len(outs[0]) == 101 + 201 + 301


def test_secrets(spark):
    got = secret_scan.scan(table(spark, ROWS))
    base = secret_scan.joined("filter(findings, f -> f.kind in ('assign', 'access', 'hex'))")
    want = [(d, ",".join(f"{k}:{a}:{b}" for k, a, b in brute.secrets(t))) for d, t in PAIRS]
    assert plain(got.withColumn("s", F.expr(base)), "doc_id", "s") == sorted(want, key=repr)
    masked = secret_scan.redact(table(spark, ROWS))
    assert masked.count() == len(ROWS) and masked.columns == table(spark, ROWS).columns
    text = masked.where("doc_id = 13").first()["text"]
    assert text == 'token="[SECRET]" token=abc [SECRET] [SECRET]'


def test_spans_of_many_matches_and_of_whole_tokens(spark):
    """More matches than a block, a jwt and a pem block, against Python's own matching."""
    import re

    jwt = "eyJ" + "a" * 10 + ".eyJ" + "b" * 10 + ".sig-nature"
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "Ab1+" * 20 + "\n-----END RSA PRIVATE KEY-----"
    many = " é ".join(f"{k:x}".zfill(24 + k % 3) for k in range(1000))
    texts = [(1, f"see {jwt} and\n{pem}\nend"), (2, many), (3, "é" * 9 + jwt + " " + jwt)]
    got = {r["doc_id"]: r["s"] for r in secret_scan.scan(spark.createDataFrame(texts, "doc_id bigint, text string")).select("doc_id", F.expr(secret_scan.joined("findings")).alias("s")).collect()}
    want = {}
    for d, t in texts:
        spans = [(m.start(), k, r.kind, m.end()) for k, r in enumerate(secret_scan.RULES) if not r.group for m in re.finditer(r.pattern, t) if m.end() - m.start() >= r.least]
        want[d] = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))
    assert got == want and "jwt" in got[1] and "pem" in got[1] and got[2].count("hex") == 1000


def test_changed_rules_make_a_new_version(spark):
    docs = spark.createDataFrame([(1, "AKIA" + "C" * 20, "a/b", 1), (1, "AKIA" + "D" * 20, "a/c", 2), (2, None, None, 1)], "doc_id bigint, text string, path string, version int")
    ledger = secret_scan.update_ledger(docs)
    fewer = secret_scan.RULES[:2]
    assert secret_scan.update_ledger(docs, ledger, fewer).count() == 3 and secret_scan.update_ledger(docs, ledger).count() == 0
    got = plain(secret_scan.scan(docs, ledger, paths=("path", "version")).withColumn("k", F.size("findings")), "path", "version", "k")
    assert got == [("a/b", 1, 1), ("a/c", 2, 1), (None, 1, 0)]


def test_secrets_scan_only_unseen_blobs(spark):
    docs = table(spark, ROWS, clash=False)
    ledger = secret_scan.update_ledger(docs)
    assert secret_scan.update_ledger(docs, ledger).count() == 0
    assert secret_scan.update_ledger(docs, ledger, rule_version=2).count() == ledger.count() == len({t or "" for _, t in PAIRS})
    assert plain(secret_scan.scan(docs, ledger), "doc_id", "blob") == plain(secret_scan.scan(docs), "doc_id", "blob")


def test_quality(spark):
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert plain(quality_rules.clean(table(spark, ROWS)), *cols) == sorted(((d, *brute.quality(t)) for d, t in PAIRS), key=repr)


def test_lines(spark):
    """Which lines are removed, by the rules read anew in Python."""
    import re

    lines = [
        "Home | About us | Contact.", "Home > News > Today!", "A | b.", "It was | as one says | a day of very long and unending walks through the park.", "NO SHOUTING HERE.", "An open line",
        "Click here to go on.", "* * * $ x.", "« Bien sûr, dit-il. »", "Fine.", "ONE TWO.", "Items • of • a • menu.", "",
    ]
    kept = []
    for x in filter(str.strip, lines):
        words, marks = len(re.split(r"[\x20\x09-\x0D]+", x)), len(re.findall(r"[#*$%&|<>]", x))
        items = re.split("[|»›•·>]", x)
        bad = x.rstrip()[-1] not in ".!?:;…\"'”»)]" or (len(items) >= 3 and all(1 <= len(i) <= 30 for i in items)) or 4 * marks >= words
        bad = bad or (x == x.upper() and x != x.lower() and words >= 3) or (words <= 30 and any(p in x.lower() for p in quality_rules.BOILERPLATE))
        kept += [] if bad else [x]
    row = quality_rules.clean(spark.createDataFrame([(1, "\n".join(lines))], "doc_id bigint, text string")).first()
    assert row["cleaned"].split("\n") == kept and row["n_lines_removed"] == len(lines) - 1 - len(kept) and "Fine." in kept and len(kept) == 4


def test_license(spark):
    rows = [(1, None), (2, ""), (3, "Licensed under the Apache License, Version 2.0.\nSee it."), (4, "SPDX-License-Identifier: MIT")]
    got = plain(license_scan.recognise(spark.createDataFrame(rows, "doc_id bigint, text string")), "doc_id", "licenses")
    assert got == [(1, []), (2, []), (3, ["Apache-2.0"]), (4, ["MIT"])]


def test_packing(spark):
    import public_tokenizers

    rows = [r for r in ROWS if r[0] is not None and r[0] not in (6, 9)]
    out = packing.pack(table(spark, rows), public_tokenizers.path("word_bpe_49k.json"), pool_tokens=1 << 14)
    pieces = [r.asDict() for r in out.withColumn("ids_crc32", F.crc32("ids")).drop("ids").collect()]
    assert_packed(pieces, [(d, t) for d, t, *_ in rows])
    again = packing.pack(table(spark, ROWS), public_tokenizers.path("word_bpe_49k.json"))
    assert again.where("start = 0").count() == len(ROWS)


ITEMS = [(1, " ".join(f"passage{i}" for i in range(20, 40))), (2, "eins zwei"), (3, None), (4, ""), (5, "passage30 PASSAGE31"), (2, "eins zwei"), (None, "word0")]


@pytest.mark.parametrize("most", [200_000, 3])
def test_decontamination(spark, most):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = table(spark, [r for r in ROWS if r[0] not in (None, 6, 9)])
    out = decontamination.decontaminate(docs, items, max_windows=most).withColumn("n_items", F.size("items").cast("bigint"))
    out = out.withColumn("sha", F.sha2(F.concat_ws(",", F.array_sort("items")), 256))
    got = plain(out, "doc_id", "n_words", "n_hit", "n_items", "sha", "contaminated")
    pairs = [(d, t) for d, t in PAIRS if d not in (None, 6, 9)]
    want = [list(r) for r in brute.contamination(pairs, ITEMS)]
    for r, (_, text) in zip(want, pairs, strict=True):
        found = sorted({str(i) for i, w in ITEMS if i is not None and brute.contamination([(0, text)], [(i, w)])[0][2]})
        r[3], r[4] = len(found), hashlib.sha256(",".join(found).encode()).hexdigest()
    assert got == sorted(map(tuple, want), key=repr)
    kept = decontamination.uncontaminated(docs, items, max_windows=most)
    assert plain(kept, "doc_id") == sorted(((r[0],) for r in want if not r[5]), key=repr)


def test_languages(spark):
    docs = table(spark, ROWS)
    model = language_id.fit(docs, F.lit(True))
    got = language_id.identify(docs, model).collect()
    assert len(got) == len(ROWS)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert language_id.accepted(docs, model).columns == docs.columns


def test_toxicity(spark):
    docs = table(spark, ROWS)
    labels = spark.createDataFrame([(6, None, 1), (7, 1, 0), (6, 0, 1), (None, 1, 1), (99, 1, None)], "doc_id bigint, quality int, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True))).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)


def test_toxicity_finds_misspelled_words_and_weighs_quotes(spark):
    finder = toxicity.Finder([("villain", False, 3.0), ("brut", True, 2.0)], set())
    assert finder.trie.find("villain") == (3.0, False) and finder.trie.find("vilain") == (3.0, True)
    assert finder.trie.find("villians") == (0.0, False) and finder.trie.find("brutal") == (2.0, False)
    text = b'he said "villain" to me'
    import numpy as np

    assert toxicity.quoted(np.frombuffer(text, np.uint8), 9, 16, 0, len(text))


def test_empty_tables(spark):
    docs = table(spark, [])
    items, labels = spark.createDataFrame([], "item_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    import public_tokenizers

    outs = [
        ngram_jaccard.join(docs), secret_scan.scan(docs), quality_rules.clean(docs), suffix_dedup.deduplicate(docs),
        substring_dedup.deduplicate(docs), packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")),
        decontamination.decontaminate(docs, items), language_id.identify(docs, language_id.fit(docs, F.lit(True))),
        license_scan.recognise(docs), toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True))),
    ]
    assert all(o.count() == 0 for o in outs)


def test_empty_benchmark_and_labels(spark):
    docs = table(spark, ROWS)
    items, labels = spark.createDataFrame([], "item_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert decontamination.decontaminate(docs, items).where("n_hit = 0 and not contaminated").count() == len(ROWS)
    assert decontamination.uncontaminated(docs, items).count() == len(ROWS)
    assert toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True))).where("score = 0").count() == len(ROWS)


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, tmp_path, k):
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table(spark, ROWS)
    out = corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path))
    assert out.count() >= 1
    if k < 4:
        assert out.columns == docs.columns
    assert corpus_pipeline.STAGES[k][1](spark, table(spark, []), str(tmp_path)).count() == 0


def test_a_line_of_very_many_items(spark):
    rows = [(1, "a|" * 1_000_000 + "a."), (2, "a|" * 3000 + "a.\n" + "word " * 60 + "."), (3, "a|b."), (4, "a||b."), (5, "home » shop » about."), (6, "x" * 31 + "|a|b."), (7, "|a|b|c.")]
    got = plain(quality_rules.clean(spark.createDataFrame(rows, "doc_id bigint, text string")), "doc_id", "n_lines", "n_lines_removed")
    # The third and fourth have four times as many marks as words or more, as has any line of bare items; the sixth and seventh too.
    assert got == [(1, 1, 1), (2, 2, 1), (3, 1, 1), (4, 1, 1), (5, 1, 1), (6, 1, 1), (7, 1, 1)]
    menu = [(k, " ".join(["several words"] * 6) + " " + line) for k, line in enumerate(("| a | b.", "a", "a."))]
    long_items = [(8, "w " * 20 + "| " + "w " * 20 + "| " + "w " * 20 + ".")]
    got = plain(quality_rules.clean(spark.createDataFrame(menu + long_items, "doc_id bigint, text string")), "doc_id", "n_lines_removed")
    assert got == [(0, 0), (1, 1), (2, 0), (8, 0)]


def test_redaction_of_very_many_findings(spark):
    import time

    one = "token=abcdef123456 and é "
    text = one * 8000
    rows = [(1, text), (2, "token=" + "ab12" * 10 + " x"), (3, "x"), (4, None), (5, "token=AKIA" + "B" * 20 + "." + "0f" * 15 + " passwd: " + "0f" * 30)]
    began = time.time()
    got = dict(plain(secret_scan.redact(spark.createDataFrame(rows, "doc_id bigint, text string")), "doc_id", "text"))
    assert time.time() - began < 60
    assert got[1] == "token=[SECRET] and é " * 8000 and got[2] == "token=[SECRET] x" and got[3] == "x" and got[4] is None
    assert got[5] == "token=[SECRET] passwd: [SECRET]"
