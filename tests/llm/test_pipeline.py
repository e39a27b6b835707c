"""Every stage of the pipeline on what its predecessor kept, against brute force."""

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm import brute
from tests.llm.test_queries import assert_packed

SF = "/root/testdata/sf0.001"


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [pairs(docs)]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(pairs(docs))
    raw, told, single, free, masked = seen
    # Languages: texts without a letter go, and hardly any other.
    assert set(told) <= set(raw) and all(any(c.isalpha() for c in t) for _, t in told)
    assert len(told) >= 0.95 * sum(bool(t) and any(c.isalpha() for c in t) for _, t in raw)
    # Near duplicates: the document that names its component stays.
    keep = {d for d, _, root in brute.jaccard(told, 5, 80) if d == root}
    assert sorted(single) == sorted(p for p in told if p[0] in keep)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute.contamination(single, items) if r[-1]}
    assert bad and sorted(free) == sorted(p for p in single if p[0] not in bad)
    # Secrets: all documents stay, no base span is left, and texts without a mark are untouched.
    before = dict(free)
    assert sorted(d for d, _ in masked) == sorted(before)
    for d, text in masked:
        assert text == before[d] or "[SECRET]" in text
        for _, a, b in brute.secrets(before[d]):
            assert before[d][a:b] not in text
    assert docs.where(F.col("n_chars") != F.length("text")).count() == spark.read.parquet(f"{tmp_path}/2").where(F.col("n_chars") != F.length("text")).count()
    pieces = [r.asDict() for r in corpus_pipeline.packed(spark, docs, SF).withColumn("ids_crc32", F.crc32("ids")).drop("ids").collect()]
    assert_packed(pieces, masked)
