"""Queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import (
    decontamination,
    fill_in_middle,
    hard_negatives,
    language_id,
    license_scan,
    ngram_jaccard,
    packing,
    quality_rules,
    secret_scan,
    substring_dedup,
    suffix_dedup,
    topk_search,
    toxicity,
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group"
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        "contaminated",
    )


def held_out(folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs, ~held_out(5, 0))
    return language_id.identify(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(4, 2))
    return toxicity.score(docs, model).select(
        "doc_id", held_out(4, 2).alias("held_out"), "score", F.expr("int(score >= 0.3)").alias("predicted")
    )


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.join(documents(spark, sf_dir), n=4, percent=85)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, sf_dir), rules=secret_scan.MATCHES)
    count = lambda kind: f"bigint(size(filter(findings, f -> f.kind = '{kind}')))"
    base = ", ".join(f"'{k}'" for k in secret_scan.BASE)
    return found.select(
        "doc_id",
        F.expr(count("assign")).alias("n_assign"),
        F.expr(count("access")).alias("n_access"),
        F.expr(count("hex")).alias("n_hex"),
        F.expr(f"sha2({secret_scan.joined(f'filter(findings, f -> f.kind in ({base}))')}, 256)").alias("base_sha256"),
        F.expr(secret_scan.joined("findings")).alias("spans"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.clean(documents(spark, sf_dir)).drop("cleaned")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.deduplicate(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.deduplicate(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.recognise(documents(spark, sf_dir))
    return found.withColumns({c: F.array_join(c, ",") for c in ("sentence_ids", "licenses")})


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label, F.expr("vec_id % 100 = 0"))


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.expr("vec_id % 50 = 0"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(documents(spark, sf_dir))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_in_middle.restored(), 256).alias("restored_sha256"))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_secret_scan": op2_secret_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op9_license_scan": op9_license_scan,
    "op6_packing": op6_packing,
    "op7_decontamination": op7_decontamination,
    "op8_language_id": op8_language_id,
    "op10_toxicity": op10_toxicity,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_topk_search": op12_topk_search,
    "op13_fill_in_middle": op13_fill_in_middle,
}

SQL: dict[str, str] = {
    "op2_secret_scan": secret_scan.SQL,
    "op3_quality_rules": quality_rules.SQL,
    "op9_license_scan": license_scan.sql(),
    "op11_hard_negatives": hard_negatives.SQL,
    "op12_topk_search": topk_search.SQL,
    "op13_fill_in_middle": fill_in_middle.SQL,
}
