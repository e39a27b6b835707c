"""Prompts: what retrieved excerpts and facts look like, what fits a budget, what an answer cites.

Tokens are those of the word tokenizer: no token crosses white space, so a block's
tokens are the sum of its parts' and the longest prefix that fits is a running sum.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.strings import word_tokens

#: The wording around excerpts, facts and sources.
HEADING = "## Reference material"
INSTRUCTION = (
    "The following excerpts are retrieved from the organization's knowledge base. Cite them when relevant. "
    "If they do not answer the question, say so rather than inventing an answer."
)
MEMORY_HEADING = "## What you know about this user"
SOURCES_HEADING = "Sources:"
RESERVE = 256


def section_of(section: Column) -> Column:
    """The section in parentheses, or nothing."""
    return F.when(F.coalesce(section, F.lit("")) == "", "").otherwise(F.concat(F.lit(" ("), section, F.lit(")")))


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def entry(handle: Column, source_name: Column, section: Column, text: Column, is_summary: Column) -> Column:
    """One numbered excerpt; a summary never calls itself a source."""
    source = F.concat(F.lit(" source: "), source_name, section_of(section))
    head = F.when(is_summary, F.concat(F.lit(" summary of: "), source_name)).otherwise(source)
    return F.concat(F.lit("["), handle.cast("string"), F.lit("]"), head, F.lit("\n"), stripped(text))


def room(base_tokens: Column, context_window: Column) -> Column:
    """Tokens left for excerpts and facts; null (no bound) for an unknown window."""
    return F.when(context_window.isNotNull(), F.greatest(F.lit(0), context_window - base_tokens - RESERVE))


def _fitting(lines: DataFrame, key: str, heading: str, budget: Column, separator: str) -> DataFrame:
    """key, place, line, used and kept: the longest prefix of each key's lines that fits its budget with the heading."""
    head = word_tokens(F.lit(heading))
    w = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    used = lines.withColumn("used", head + F.sum(word_tokens(F.col("line"))).over(w))
    return used.withColumn("kept", F.col("used") <= budget)


def _block(fitted: DataFrame, key: str, heading: str, separator: str) -> DataFrame:
    """The rendered block of each key's kept lines, with its tokens; keys that keep nothing have none."""
    kept = fitted.where("kept").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("l"), F.max("used").alias("tokens"))
    return kept.select(key, F.concat(F.lit(heading + separator), F.array_join(F.col("l.line"), separator)).alias("text"), "tokens", F.size("l").alias("kept"))


def fit_documents(chunks: DataFrame, key: str, budget: Column) -> DataFrame:
    """Which excerpts (place, source_name, section, text, is_summary) of each key are injected: a prefix by rank whose block fits."""
    lines = chunks.withColumn("line", entry(F.col("place"), F.col("source_name"), F.col("section"), F.col("text"), F.col("is_summary")))
    return _fitting(lines, key, f"{HEADING}\n{INSTRUCTION}", budget, "\n\n")


def render_documents(fitted: DataFrame, key: str) -> DataFrame:
    return _block(fitted, key, f"{HEADING}\n{INSTRUCTION}", "\n\n")


def fit_facts(facts: DataFrame, key: str, budget: Column) -> DataFrame:
    """Which facts (place, text) of each key are injected; empty ones are no bullets."""
    lines = facts.withColumn("line", F.concat(F.lit("- "), one_line(F.col("text")))).where("line <> '- '")
    return _fitting(lines, key, MEMORY_HEADING, budget, "\n")


def render_facts(fitted: DataFrame, key: str) -> DataFrame:
    return _block(fitted, key, MEMORY_HEADING, "\n")


def assembled(requests: DataFrame, chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """Each request's injected blocks and why excerpts and facts were dropped.

    requests: id, base_tokens, context_window, doc_max_tokens, memory_max_tokens; chunks and facts carry the id.
    Excerpts are fitted first, then facts in what they leave.
    """
    space = room(F.col("base_tokens"), F.col("context_window"))
    given = requests.withColumn("room", space).withColumn("doc_budget", F.least("doc_max_tokens", "room"))
    docs = fit_documents(chunks.join(given.select("id", "doc_budget"), "id"), "id", F.col("doc_budget"))
    told = given.join(render_documents(docs, "id").select("id", F.col("text").alias("documents"), F.col("tokens").alias("doc_tokens"), F.col("kept").alias("injected")), "id", "left")
    told = told.withColumn("doc_tokens", F.coalesce("doc_tokens", F.lit(0)))
    left = F.col("room") - F.col("doc_tokens")
    told = told.withColumn("memory_budget", F.greatest(F.lit(0), F.least(F.col("memory_max_tokens"), left)))
    bullets = fit_facts(facts.join(told.select("id", "memory_budget"), "id"), "id", F.col("memory_budget"))
    memory = render_facts(bullets, "id").select("id", F.col("text").alias("memory"), F.col("tokens").alias("memory_tokens"), F.col("kept").alias("injected_facts"))
    told = told.join(memory, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return told.select(
        "id",
        "documents",
        "memory",
        zero("injected").alias("injected"),
        zero("injected_facts").alias("injected_facts"),
        F.when(F.col("room") < F.col("doc_max_tokens"), "context_window").otherwise("doc_max_tokens").alias("documents_bound"),
        F.when(left < F.col("memory_max_tokens"), "context_window").otherwise("memory_max_tokens").alias("memory_bound"),
        (F.col("base_tokens") + F.col("doc_tokens") + zero("memory_tokens")).alias("prompt_tokens"),
    )


_FENCE = re.compile(r"^ {0,3}(```|~~~)")
_HANDLE = re.compile(r"(?:(?<!\w)\[|\[\^)(\d{1,3}(?:\s*[,\-–]\s*\d{1,3})*)\]")
LONGEST_RANGE = 20


def numbers(group: str) -> list[int]:
    """Numbers of a handle's inside; a range that is reversed or too long is its two ends."""
    out: list[int] = []
    for part in group.split(","):
        ends = [int(x) for x in re.split(r"[\-–]", part)]
        short = len(ends) == 2 and ends[0] <= ends[1] <= ends[0] + LONGEST_RANGE
        out += range(ends[0], ends[1] + 1) if short else ends[:2] if len(ends) == 2 else ends[:1]
    return out


def handles_of(text: str | None) -> list[tuple[int, int, list[int]]]:
    """(start, end, numbers) of every citation handle outside fenced code."""
    found: list[tuple[int, int, list[int]]] = []
    at, fenced = 0, False
    for line in (text or "").splitlines(keepends=True):
        if _FENCE.match(line):
            fenced = not fenced
        elif not fenced:
            chain = -1  # a handle right after ] counts only if that ] closed a handle
            for m in _HANDLE.finditer(line):
                if line[m.start() - 1 : m.start()] == "]" and chain != m.start():
                    continue
                found.append((at + m.start(), at + m.end(), numbers(m[1])))
                chain = m.end()
        at += len(line)
    return found


RESOLVED = "cited array<int>, unresolved array<int>, spans array<struct<start:int,end:int>>"


def resolved(answers: DataFrame) -> DataFrame:
    """id, cited (handles in order of first use), unresolved, spans of answers (id, text, injected).

    Line state and chained brackets go beyond SQL's expressions, so batches of texts go through Python.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, text, injected in zip(frame["id"], frame["text"], frame["injected"], strict=True):
                found = handles_of(text)
                order = list(dict.fromkeys(n for *_, ns in found for n in ns))
                good = [n for n in order if 1 <= n <= injected]
                rows.append((key, good, [n for n in order if n not in good], [{"start": a, "end": b} for a, b, _ in found]))
            yield pd.DataFrame(rows, columns=["id", "cited", "unresolved", "spans"])

    return answers.select("id", "text", "injected").mapInPandas(run, f"id bigint, {RESOLVED}")


def footer(citations: DataFrame, key: str) -> DataFrame:
    """The list of sources under an answer: handles (place orders them) with their labels; nothing for no citation."""
    line = F.concat(F.lit("["), F.col("handle").cast("string"), F.lit("] "), F.col("label"))
    lines = citations.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("l"))
    return lines.select(key, F.concat(F.lit(f"\n\n{SOURCES_HEADING}\n"), F.array_join(F.col("l.line"), "\n")).alias("footer"))


def delivered(answers: DataFrame, mode: str, prefix: Column | None = None, suffix: Column | None = None) -> DataFrame:
    """id, text, citations, unresolved: answers (id, text, injected, cited, unresolved, spans, footer) as a client gets them.

    off leaves the text alone, metadata adds the handles beside it, footer takes unresolved handles out and puts the
    sources below.  Where nothing was injected no mode does anything.  Prefix and suffix go around the text in every mode.
    """
    if mode not in ("off", "metadata", "footer"):
        raise ValueError(f"unknown citation mode {mode!r}")
    some = F.col("injected") > 0
    none = F.lit(None).cast("array<int>")
    body = F.when(some, F.concat(without(F.col("text"), F.col("spans"), F.col("unresolved")), F.coalesce("footer", F.lit("")))).otherwise(F.col("text")) if mode == "footer" else F.col("text")
    around = [c for c in (prefix, body, suffix) if c is not None]
    beside = lambda c: F.when(some, F.col(c)) if mode == "metadata" else none
    return answers.select("id", F.concat(*around).alias("text"), beside("cited").alias("citations"), beside("unresolved").alias("unresolved"))


def without(text: Column, spans: Column, unresolved: Column) -> Column:
    """The text with handles of unresolved numbers only taken out; spans are in order and apart."""
    hollow = F.filter(spans, lambda s: F.forall(F.transform(F.regexp_extract_all(F.substring(text, s["start"] + 1, s["end"] - s["start"]), F.lit(r"\d+"), F.lit(0)), lambda n: n.cast("int")), lambda n: F.array_contains(unresolved, n)))
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))
    done = F.aggregate(
        hollow, start, lambda a, s: F.struct(F.concat(a["kept"], F.substring(text, a["at"] + 1, s["start"] - a["at"])).alias("kept"), s["end"].alias("at"))
    )
    return F.concat(done["kept"], F.substring(text, done["at"] + 1, F.length(text)))
