"""Findings of a chunk index: fragments, ceilings, broken sentences, mixed cuts, drifted vectors.

Points have connector_id, kind, document_id, chunk_index, token_count, text and
fingerprint.  One pass counts by document, a second one by connector and kind; only
those small rows become findings (code, count, documents, severity).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.catalog import PROSE

#: A fragment's tokens, shares of a chunk's size, and how similar a fresh vector must be.
FLOOR, CEILING, OVER, HEALTHY = 40, 0.9, 1.5, 0.95
SEVERITIES = ("green", "amber", "red")


def worse(rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(s) for s in SEVERITIES)), rank + 1)


def chunk_findings(points: DataFrame, size: int, fixed: bool = False) -> DataFrame:
    """connector_id, kind, code, count, documents, severity; a code that counts nothing is no finding.

    `fixed` says that chunks are cut at the ceiling on purpose.
    """
    tokens = F.col("token_count")
    mid = F.col("kind").isin(*PROSE) & (F.col("chunk_index") > 0) & F.coalesce(F.regexp_replace("text", r"^\s+", "").rlike(r"^\p{Ll}"), F.lit(False))
    tests = {
        "short_chunks": tokens < FLOOR,
        "at_ceiling": tokens.between(int(size * CEILING), size),
        "over_ceiling": tokens > int(size * OVER),
        "mid_sentence_starts": mid,
    }
    by_document = points.groupBy("connector_id", "kind", "document_id").agg(F.count("*").alias("n"), *(F.count_if(t).alias(c) for c, t in tests.items()))
    sums = [x for c in tests for x in (F.sum(c).alias(c), F.count_if(F.col(c) > 0).alias(f"docs_{c}"))]
    by_kind = by_document.groupBy("connector_id", "kind").agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("single"), *sums)
    share = lambda c: F.col(c) / F.col("n")
    rank = lambda high, low, when: F.when(when, high).otherwise(low)
    rows = [
        ("short_chunks", F.col("short_chunks"), F.col("docs_short_chunks"), rank(2, 1, share("short_chunks") >= 0.10)),
        ("single_chunk_documents", F.col("single"), F.col("single"), F.lit(1)),
        ("at_ceiling", F.col("at_ceiling"), F.col("docs_at_ceiling"), rank(0, 1, F.lit(fixed) | (share("at_ceiling") < 0.5))),
        ("over_ceiling", F.col("over_ceiling"), F.col("docs_over_ceiling"), F.lit(2)),
        ("mid_sentence_starts", F.col("mid_sentence_starts"), F.col("docs_mid_sentence_starts"), rank(2, 1, share("mid_sentence_starts") >= 0.25)),
    ]
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("code"), n.alias("count"), d.alias("documents"), worse(s).alias("severity")) for c, n, d, s in rows)))
    return by_kind.select("connector_id", "kind", each.alias("_found")).select("connector_id", "kind", "_found.*").where(F.col("count") > 0)


def merged(findings: DataFrame) -> DataFrame:
    """Findings of all kinds as one for each connector and code: counts add up, the worst severity stays."""
    rank = F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), F.col("severity")) - 1
    both = findings.groupBy("connector_id", "code").agg(F.sum("count").alias("count"), F.sum("documents").alias("documents"), F.max(rank).cast("int").alias("_r"))
    return both.select("connector_id", "code", "count", "documents", worse(F.col("_r")).alias("severity"))


def worst(findings: DataFrame) -> DataFrame:
    return merged(findings.withColumn("code", F.lit(""))).select("connector_id", "severity")


def top_documents(points: DataFrame, condition: Column, shown: int = 10) -> DataFrame:
    """The documents of each connector with the most points of a condition."""
    tally = points.where(condition).groupBy("connector_id", "document_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("connector_id").orderBy(F.desc("n"), "document_id")
    return tally.withColumn("place", F.row_number().over(w)).where(F.col("place") <= shown)


def mixed_fingerprints(points: DataFrame) -> DataFrame:
    """Connectors cut in several ways: how many, and the points and documents outside of the most common one (ties: the least)."""
    by_document = points.groupBy("connector_id", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"), "document_id").agg(F.count("*").alias("n"))
    tally = by_document.groupBy("connector_id", "fingerprint").agg(F.sum("n").alias("n"))
    main = tally.groupBy("connector_id").agg(F.count("*").alias("fingerprints"), F.min(F.struct(-F.col("n"), "fingerprint")).alias("m")).where("fingerprints > 1")
    rest = by_document.join(main.select("connector_id", "fingerprints", F.col("m.fingerprint").alias("main")), "connector_id").where("fingerprint <> main")
    return rest.groupBy("connector_id", "fingerprints").agg(F.sum("n").alias("count"), F.count_distinct("document_id").alias("documents"))


def drift(samples: DataFrame) -> DataFrame:
    """model, sampled, mean, low, p5, below and shape of the similarities of stored and fresh vectors."""
    stats = samples.groupBy("model").agg(
        F.count("*").alias("sampled"), F.avg("cosine").alias("mean"), F.min("cosine").alias("low"), F.max("cosine").alias("high"),
        F.expr("percentile_disc(0.05) within group (order by cosine)").alias("p5"), (F.count_if(F.col("cosine") < HEALTHY) / F.count("*")).alias("below"),
    )
    below = F.col("below")
    shape = (
        F.when((below == 0) | ((F.col("mean") >= HEALTHY) & (below < 0.05)), "healthy")
        .when(below.between(0.2, 0.8), "bimodal")
        .when((below > 0.8) & (F.col("high") - F.col("low") < 0.2), "offset")
        .otherwise("low")
    )
    return stats.select("model", "sampled", F.round("mean", 6).alias("mean"), "low", "p5", F.round("below", 6).alias("below"), shape.alias("shape"))


def fingerprint_differences(recorded: Column, expected: Column) -> Column:
    """Names of the segments that differ, in report order; null for a fingerprint that can't be read."""
    from quillspark.operators.lifecycle import SEGMENTS

    was, now = F.str_to_map(recorded, F.lit(";"), F.lit("=")), F.str_to_map(expected, F.lit(";"), F.lit("="))
    readable = F.size(F.array_intersect(F.map_keys(was), F.array(*(F.lit(n) for n, _ in SEGMENTS)))) == len(SEGMENTS)
    each = F.array(*(F.when(was[n] != now[n], F.lit(reason)) for n, reason in SEGMENTS))
    return F.when(F.coalesce(readable, F.lit(False)), F.filter(each, lambda x: x.isNotNull()))


def index_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Connectors whose snapshot (documents, fingerprint) differs between two runs, and how."""
    b = before.select("connector_id", F.col("documents").alias("had"), F.col("fingerprint").alias("was"), F.lit(True).alias("b"))
    a = after.select("connector_id", F.col("documents").alias("has"), F.col("fingerprint").alias("now"), F.lit(True).alias("a"))
    both = b.join(a, "connector_id", "full_outer")
    change = (
        F.when(F.col("b").isNull(), "attached")
        .when(F.col("a").isNull(), "detached")
        .when(~F.col("was").eqNullSafe(F.col("now")), "recut")
        .when(~F.col("had").eqNullSafe(F.col("has")), "documents")
    )
    return both.select("connector_id", change.alias("change"), (F.coalesce("has", F.lit(0)) - F.coalesce("had", F.lit(0))).alias("documents_delta")).where("change is not null")
