"""Scalar functions of texts, keys and messages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Secrets and personal data that logs must not keep.
REDACTIONS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    (r"sk-[A-Za-z0-9]{16,}", "[KEY]"),
    (r"\d{3}-\d{2}-\d{4}", "[SSN]"),
    (r"(?:\d[ -]?){13,16}", "[CARD]"),
)


def folded(text: Column) -> Column:
    """Lower case, white space runs as one blank, trimmed."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def text_hash(text: Column) -> Column:
    return F.sha2(folded(text), 256)


def clean_key(key: Column, limit: int = 200) -> Column:
    return F.substring(F.trim(F.regexp_replace(key, r"[\x00-\x1f\x7f-\x9f]", "")), 1, limit)


def anonymous_id(api_key_id: Column, client_ip: Column) -> Column:
    return F.concat(F.lit("anon:"), F.substring(F.sha2(F.concat(api_key_id.cast("string"), client_ip.cast("string")), 256), 1, 16))


def word_tokens(text: Column) -> Column:
    """Number of tokens: runs of letters, digits and _, and every other mark that isn't white space."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)(\w+|[^\w\s])"), F.lit(0)))


def redact(text: Column) -> Column:
    """The whole text without secrets and personal data; the patterns take linear time, so no text needs a cut."""
    out = text
    for pattern, mark in REDACTIONS:
        out = F.regexp_replace(out, pattern, mark)
    return out


def reinforced(stored: Column, observed: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(stored, stored + (1 - stored) / 3, observed))


def parse_summary(reply: Column) -> Column:
    """A model's summary: quotes and a leading 'Summary:' go, white space folds, 4000 characters stay."""
    bare = F.regexp_replace(F.trim(reply), r"(?i)^[\"']*\s*summary:\s*", "")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(bare, r"^[\"']+|[\"']+$", ""), r"\s+", " ")), 1, 4000)


def handles(text: Column) -> Column:
    """Numbers of citation handles [n], [n, m] and [n-m], outside fenced code; sorted, each once."""
    prose = F.regexp_replace(text, r"(?s)```.*?(```|$)", " ")
    # Cut and tested piece by piece: a pattern with a repeated group needs a stack as deep as a bracket has numbers.
    groups = F.filter(F.regexp_extract_all(prose, F.lit(r"\[(\d[\d\s,-]*)\]"), F.lit(1)), lambda g: F.forall(F.split(g, r"\s*[,-]\s*"), lambda x: x.rlike(r"^\d{1,4}$")))
    parts = F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*")))

    def numbers(p: Column) -> Column:
        ends = F.transform(F.split(p, r"\s*-\s*"), lambda x: x.cast("int"))
        low, high = F.element_at(ends, 1), F.element_at(ends, -1)
        return F.when((high >= low) & (high - low <= 50), F.sequence(low, F.greatest(low, high))).otherwise(ends)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, numbers))))


#: Phrases and marks of text aimed at a model, and bare imperatives.
OVERRIDES = (
    "ignore previous", "ignore all previous", "ignore the above", "ignore your", "disregard", "system prompt", "system message", "previous instructions",
    "new instructions", "from now on", "act as", "acts as if you", "pretend to be", "you are now", "override", "jailbreak",
)
MARKUP = ("```", "<|", "|>", "\x00")
IMPERATIVES = (
    "answer reply respond say tell write output print speak translate format avoid mention include provide give treat assume act pretend remember forget ignore use do make be start stop only please"
).split()
HEDGES = ("always", "never")
SECOND_PERSON = r"\b(you|your|yours|yourself|you're|youre)\b"


def reads_as_an_instruction(text: Column) -> Column:
    """The sentence is aimed at a reader: second person, a phrase or mark of prompts, or a bare imperative, also after always and never."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit("[a-z']+"), F.lit(0))
    first, second = F.get(words, F.lit(0)), F.coalesce(F.get(words, F.lit(1)), F.lit(""))
    order = first.isin(*HEDGES) & (second.isin("", *IMPERATIVES) | ~second.endswith("s"))
    holds = lambda of, parts: F.array_contains(F.transform(F.array(*(F.lit(p) for p in parts)), lambda p: F.contains(of, p)), True)
    return low.rlike(SECOND_PERSON) | holds(low, OVERRIDES) | holds(text, MARKUP) | F.coalesce(first.isin(*IMPERATIVES) | order, F.lit(False))


def layered(*maps: Column) -> Column:
    """Parameter layers, the later one winning."""
    return F.map_from_entries(
        F.filter(
            F.transform(F.array_distinct(F.flatten(F.array(*(F.map_keys(m) for m in maps)))), lambda k: F.struct(k.alias("k"), F.coalesce(*(F.try_element_at(m, k) for m in reversed(maps))).alias("v"))),
            lambda e: e["v"].isNotNull(),
        )
    )
