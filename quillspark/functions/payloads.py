"""Column expressions over stored points, ids and models."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# The namespace of point ids, words of a summary for each token, and tokenizers by dialect and beginning of a model's name.
NAMESPACE = uuid.UUID("6f4d1f4c-1f6a-5f9a-9a4e-6a1f0d2c3b45")
WORDS_PER_TOKEN = 0.75
TOKENIZERS = (
    ("openai", "gpt-4o", "o200k_base"),
    ("openai", "chatgpt-4o", "o200k_base"),
    ("openai", "gpt-4.1", "o200k_base"),
    ("openai", "gpt-5", "o200k_base"),
    ("openai", "o1", "o200k_base"),
    ("openai", "o3", "o200k_base"),
    ("openai", "o4", "o200k_base"),
    ("openai", "gpt-4", "cl100k_base"),
    ("openai", "gpt-3.5", "cl100k_base"),
    ("openai", "text-embedding-3", "cl100k_base"),
    ("openai", "text-embedding-ada", "cl100k_base"),
    ("openai", "text-davinci", "p50k_base"),
    ("openai", "code-davinci", "p50k_base"),
    (None, "claude", "claude"),
    ("anthropic", "", "claude"),
)
FALLBACK = "approximate"


def derived_tokenizer(dialect: Column, model_id: Column) -> Column:
    """The tokenizer of the longest beginning that fits the model id, whole or after its last slash."""
    whole = F.lower(F.trim(model_id))
    bare = F.substring_index(whole, "/", -1)

    def fits(of: str | None, start: str) -> Column:
        named = F.startswith(whole, F.lit(start)) | F.startswith(bare, F.lit(start))
        return named if of is None else named & (dialect == of)

    found = F.array(*(F.when(fits(of, start), F.struct(F.lit(len(start)).alias("n"), F.lit(name).alias("name"))) for of, start, name in TOKENIZERS))
    return F.coalesce(F.array_max(found)["name"], F.lit(FALLBACK))


def point_id(document_id: Column, chunk_index: Column) -> Column:
    """The name-based (version 5) UUID of document:index in the points' namespace, as text."""
    name = F.concat_ws(":", document_id.cast("string"), chunk_index.cast("string"))
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("bigint").bitwiseAND(3).bitwiseOR(8)))
    part = lambda at, n: F.substring(digest, at, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def timestamp_ms(id_: Column) -> Column:
    """Milliseconds in a time-ordered (version 7) UUID's first 48 bits."""
    return F.conv(F.substring(F.replace(id_, F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("bigint")


def contextual_text(context: Column, text: Column) -> Column:
    """A summary above its text; without a summary the text."""
    return F.when(F.coalesce(context, F.lit("")) != "", F.concat_ws("\n\n", F.trim(context), text)).otherwise(text)


def embedding_input(context: Column, embedded: Column, text: Column) -> Column:
    """What a point's vector was made from: the context over what was embedded, or over the text."""
    return contextual_text(context, F.coalesce(F.nullif(embedded, F.lit("")), text, F.lit("")))


def words_for(tokens: Column) -> Column:
    return F.greatest(F.lit(20), F.floor(tokens * WORDS_PER_TOKEN))


def log_entry(chunk: dict[str, Column], injected: Column, dropped: Column) -> Column:
    """A retrieved chunk as it is logged: JSON with the score at six places; kind, stale and dropped only where they say something."""
    extra = {
        "kind": F.when(chunk["kind"] != "source", chunk["kind"]),
        "stale": F.when(chunk["stale"], F.lit(True)),
        "dropped": dropped,
    }
    plain = [F.round(c, 6).alias(n) if n == "score" else c.alias(n) for n, c in chunk.items() if n not in extra]
    return F.to_json(F.struct(*plain, injected.alias("injected"), *(c.alias(n) for n, c in extra.items())))


def retry_decision(attempt: Column, permanent: Column, error: Column, most: int = 5, base_seconds: float = 2.0, cap_seconds: float = 300.0) -> Column:
    """action, reason, ceiling_seconds: dead for a permanent error or after the last attempt, else a retry within a doubling, capped delay."""
    first_line = F.substring(F.regexp_extract(F.trim(error), r"^[^\r\n]*", 0), 1, 500)
    spent = F.concat(F.lit("failed after "), attempt.cast("string"), F.lit(" attempts: "), first_line)
    reason = F.when(permanent, error).when(attempt >= most, spent)
    ceiling = F.least(F.lit(base_seconds) * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1)), F.lit(cap_seconds))
    return F.struct(F.when(reason.isNull(), "retry").otherwise("dead").alias("action"), reason.alias("reason"), F.when(reason.isNull(), ceiling).alias("ceiling_seconds"))
