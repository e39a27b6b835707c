"""The corpus pipeline: from raw documents to packed training windows.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept
and returns a DataFrame, which is written as Parquet and read back for the next.
All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontamination, language_id, ngram_jaccard, packing, queries, secret_scan
from quillspark.llm.common import BATCH_ROWS, BATCH_ROWS_CONF, Scratch


def bounded(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts short in this session: an executor holds several at a time, in the JVM and in its workers."""
    rows = int(spark.conf.get(BATCH_ROWS_CONF))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(BATCH_ROWS_CONF, str(BATCH_ROWS))


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    bounded(spark)
    return language_id.accepted(docs, language_id.fit(docs, ~queries.held_out(5, 0)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    bounded(spark)
    return ngram_jaccard.one_of_each(docs, n=5, percent=80)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages don't contaminate."""
    bounded(spark)
    return decontamination.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; n_chars follows the text."""
    # A length that no longer fits follows the text; the old text's length travels in n_chars' own place.
    both = docs.withColumn("n_chars", F.struct("n_chars", F.length("text").alias("was")))
    masked = secret_scan.redact(both)
    n_chars = F.when(F.length("text") != F.col("n_chars.was"), F.length("text").cast("bigint")).otherwise(F.col("n_chars.n_chars"))
    return masked.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training windows, with their ids."""
    import public_tokenizers

    bounded(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", languages),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_free),
    ("secret_scan", secrets_masked),
    ("packing", packed),
]

#: Neither n-gram classifiers nor a tokenizer can be said in SQL; the tests hold every stage against a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.cut(docs)
    return docs
