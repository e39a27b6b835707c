"""Conversations from transcripts, label texts found again after a recut, and excerpts."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.slices import slices
from quillspark.functions.strings import folded

#: Characters of an exchange, the least shared block of a label and its share, the head's share and the elision.
EXCHANGE_CHARS, SHARED_CHARS, SHARED_PART = 12_000, 60, 0.5
HEAD_SHARE, ELISION = 0.75, "\n\n[…]\n\n"
TURN = "struct<role:string,text:string>"


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def turns_of(messages: Column, answer: Column) -> Column:
    """Turns of users and assistants among messages (role, content), then the answer; empty ones go, and other roles."""
    said = F.transform(F.coalesce(messages, F.array().cast(f"array<{TURN}>")), lambda m: F.struct(m["role"].alias("role"), one_line(m["text"]).alias("text")))
    kept = F.filter(said, lambda t: t["role"].isin("user", "assistant") & (t["text"] != ""))
    last = F.struct(F.lit("assistant").alias("role"), one_line(answer).alias("text"))
    return F.concat(kept, F.when(one_line(answer) != "", F.array(last)).otherwise(F.array().cast(f"array<{TURN}>")))


def exchanges(transcripts: DataFrame, keys: list[str], order: str, budget: int = EXCHANGE_CHARS) -> DataFrame:
    """keys, turns: the transcripts (turns) of a thread as one conversation.

    One that extends what is held replaces it; of any other, turns not seen yet are added.  The
    most recent whole turns within the budget stay, at least one.  A thread without turns has an
    empty list.  Threads are bounded by their conversation, not by the table.
    """
    none = F.array().cast(f"array<{TURN}>")
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("turns").alias("turns")))), lambda x: x["turns"])

    def merge(held: Column, new: Column) -> Column:
        extends = F.slice(new, 1, F.size(held)) == held
        return F.when((F.size(new) > 0) & extends, new).otherwise(F.concat(held, F.filter(new, lambda t: ~F.array_contains(held, t))))

    threads = transcripts.groupBy(*keys).agg(F.aggregate(listed, none, merge).alias("turns"))
    # the number of turns that fit, counted from the last one
    start = F.struct(F.lit(0).alias("kept"), F.lit(budget).alias("room"), F.lit(False).alias("full"))

    def take(state: Column, turn: Column) -> Column:
        cost = F.length(turn["text"]) + F.length(turn["role"]) + 2
        full = state["full"] | ((cost > state["room"]) & (state["kept"] > 0))
        return F.struct(
            (state["kept"] + F.when(full, 0).otherwise(1)).alias("kept"),
            (state["room"] - F.when(full, 0).otherwise(cost)).alias("room"),
            full.alias("full"),
        )

    kept = F.aggregate(F.reverse("turns"), start, take)["kept"]
    return threads.select(*keys, F.expr("turns").alias("all"), kept.alias("n")).select(*keys, F.slice("all", F.size("all") - F.col("n") + 1, F.col("n")).alias("turns"))


def _may_share(wanted: str, body: str, least: int) -> bool:
    """False only if no run of `least` characters stands in both: such a run holds a whole block of half its length of the body."""
    half = (least + 1) // 2
    return len(body) >= least and any(body[at : at + half] in wanted for at in range(0, len(body) - half + 1, half))


def reanchored(labels: DataFrame, chunks: DataFrame) -> DataFrame:
    """label_id, chunk_id, place: the chunks of a label's document that now hold its text.

    Whole containment wins and gives the first chunk.  Else those chunks qualify that share a
    run of 60 characters (half the label, if shorter), in the order of their parts in the label.
    Labels (label_id, document_id, text) and chunks (chunk_id, document_id, chunk_index, text)
    meet by document; a blank label is nowhere.
    """
    pairs = labels.select("label_id", "document_id", folded(F.col("text")).alias("wanted")).where("wanted <> ''").join(
        chunks.select("chunk_id", "document_id", "chunk_index", folded(F.col("text")).alias("body")), "document_id"
    )
    whole = F.contains("body", F.col("wanted"))
    exact = pairs.where(whole).groupBy("label_id").agg(F.min_by("chunk_id", F.struct("chunk_index", "chunk_id")).alias("chunk_id"))
    rest = pairs.join(exact.select("label_id"), "label_id", "left_anti").where("body <> ''")

    def shared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "body"):
            out = []
            for label, chunk, wanted, body in frame.itertuples(index=False):
                least = min(SHARED_CHARS, max(1, int(len(wanted) * SHARED_PART)))
                if not _may_share(wanted, body, least):
                    continue
                match = difflib.SequenceMatcher(None, wanted, body, autojunk=False).find_longest_match()
                if match.size >= least:
                    out.append((label, chunk, match.a))
            yield pd.DataFrame(out, columns=["label_id", "chunk_id", "place"])

    parts = rest.select("label_id", "chunk_id", "wanted", "body").mapInPandas(shared, "label_id bigint, chunk_id string, place int")
    return exact.select("label_id", "chunk_id", F.lit(0).alias("place")).unionByName(parts)


_TOKEN = re.compile(r"\w+|[^\w\s]")


def excerpts(texts: DataFrame, most: int) -> DataFrame:
    """id, excerpt, tokens, truncated: the text, or three quarters of the token bound from its head and the rest from its tail."""
    head = max(1, int(most * HEAD_SHARE))
    tail = max(0, most - head)

    def cut(text: str) -> tuple[str, int, bool]:
        bare = text.strip()
        starts = [m.start() for m in _TOKEN.finditer(bare)]
        if len(starts) <= most:
            return bare, len(starts), False
        end = bare[starts[len(starts) - tail] :].lstrip() if tail else ""
        return bare[: starts[head]].rstrip() + (ELISION + end if end else ""), head + tail, True

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            parts = [cut(t or "") for t in frame["text"]]
            yield pd.DataFrame({"id": frame["id"], **{c: [p[i] for p in parts] for i, c in enumerate(("excerpt", "tokens", "truncated"))}})

    return texts.select(F.col("id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "id bigint, excerpt string, tokens int, truncated boolean")
