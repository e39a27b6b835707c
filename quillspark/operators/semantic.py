"""Chunks that end where a text changes its subject.

Spans (sentences, or runs of them where a document's spans are bounded) are listed by document and embedded beside
their neighbours, so that only cosine distances leave a task; a document's spans are folded into chunks in SQL.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.embedding import counts
from quillspark.functions.slices import bounds, give_back, slices
from quillspark.functions.strings import word_tokens
from quillspark.operators.sections import SENTENCE_END
from quillspark.operators.text import chunks_of

#: Fixed value: the most spans of a document where they are bounded, as an embedder that is paid for by the text asks.
MAX_SPANS = 1500


def spans(sections: DataFrame, key: str = "doc_id", most: int | None = MAX_SPANS) -> DataFrame:
    """key, section, place, text, tokens: sentences in order, never across sections.

    A document of more than `most` sentences has runs of them, equally long, as its spans; with None each sentence is one.
    """
    parts = F.filter(F.split(F.trim("text"), SENTENCE_END), lambda s: s != "")
    # Dealt before they are parted, so that this isn't done by the few tasks that read the table.
    sentences, runs = sections.repartition(key).select(key, "section", parts.alias("parts")), F.col("parts")
    if most is not None:
        sentences = sentences.withColumn("n", F.sum(F.size("parts")).over(Window.partitionBy(key)))
        stride = F.greatest(F.lit(1), F.ceil(F.col("n") / most)).cast("int")
        runs = F.transform(F.sequence(F.lit(1), F.size("parts"), stride), lambda i: F.array_join(F.slice("parts", i, stride), ""))
    each = sentences.where(F.size("parts") > 0).select(key, "section", F.posexplode(runs).alias("place", "text"))
    return each.withColumn("tokens", word_tokens(F.col("text")))


def _apart(texts: list[str]) -> list[float | None]:
    """The cosine distance of each text to the one before; null for the first one."""
    out: list[float | None] = []
    before, length = None, 0.0
    for found in map(counts, texts):
        own = sum(x * x for x in found.values())
        out.append(None if before is None else 1 - sum(x * before.get(at, 0.0) for at, x in found.items()) / math.sqrt(own * length))
        before, length = found, own
    return out


def distances(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and spans (section, place, text, tokens, distance), in order, of each document.

    distance is the cosine distance (nine places, so that equal ones tie) to the span before; null for a document's first one.  A span's
    vector is made beside its neighbour's and never leaves the task.
    """
    listed = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("section", "place", "text", "tokens"))).alias("spans"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(pc.struct_field(batch.column(1).flatten(), "text")).to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
            upto = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], ends))]
            for at, end in bounds(np.diff(upto)):
                part = batch.slice(at, end - at)
                told = [_apart(pc.struct_field(s.values, "text").to_pylist()) for s in part.column(1)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(told, pa.list_(pa.float64()))], [*part.schema.names, "apart"])
            give_back()

    told = listed.mapInArrow(run, f"{fields}, apart array<double>")
    both = F.zip_with("spans", "apart", lambda s, d: F.struct(*(s[c].alias(c) for c in ("section", "place", "text", "tokens")), F.round(d, 9).alias("distance")))
    return told.select(key, both.alias("spans"))


def nearest_rank(values: Column, percentile: int) -> Column:
    """The value at the ceil rank of an array; null if it is empty."""
    rank = F.greatest(F.lit(1), F.ceil(F.size(values) * percentile / 100)).cast("int")
    return F.get(F.array_sort(values), rank - 1)


def chunks(sections: DataFrame, size: int, percentile: int = 95, floor: int = 100, atomic: bool = False, key: str = "doc_id", most: int | None = None) -> DataFrame:
    """key, chunk_index, text, token_count of sections (key, section, text).

    Every end of a sentence is looked at, but for documents of more than `most` sentences where that is given (see `spans`).

    A chunk ends before a span that would take it over `size`, that is farther from its neighbour
    than the document's percentile once the chunk has `floor` tokens (half of `size` at most), or
    that opens another section where sections are atomic.  A single span longer than `size` is
    cut at token windows.  Null and blank texts have no chunks; equal distances never cut.
    """
    least = min(floor, size // 2)
    listed = distances(spans(sections.where(F.trim("text") != ""), key, most), key)
    gaps = F.filter(F.transform("spans", lambda s: s["distance"]), lambda d: d.isNotNull())
    ranked = listed.withColumn("threshold", nearest_rank(gaps, percentile))

    chunk_type = "struct<text:string,tokens:int,section:int>"

    def fold(held: Column, s: Column) -> Column:
        """The chunks that are ended, and the one that still grows."""
        done, last = held["done"], held["last"]
        far = F.coalesce(s["distance"] > F.col("threshold"), F.lit(False)) & (last["tokens"] >= least)
        over = (last["tokens"] + s["tokens"] > size) & (last["tokens"] > 0)
        cut = over | far | (F.lit(atomic) & (last["section"] != s["section"]))
        between = F.when(last["section"] == s["section"], "").otherwise("\n\n")
        fresh = F.struct(s["text"].alias("text"), s["tokens"].cast("int").alias("tokens"), s["section"].cast("int").alias("section"))
        longer = F.struct(F.concat(last["text"], between, s["text"]).alias("text"), (last["tokens"] + s["tokens"]).cast("int").alias("tokens"), last["section"].alias("section"))
        state = lambda done, last: F.struct(done.alias("done"), last.alias("last"))
        return F.when(last.isNull(), state(done, fresh)).when(cut, state(F.concat(done, F.array(last)), fresh)).otherwise(state(done, longer))

    none = F.struct(F.array().cast(f"array<{chunk_type}>").alias("done"), F.lit(None).cast(chunk_type).alias("last"))
    groups = F.aggregate("spans", none, fold, lambda held: F.concat(held["done"], F.array(held["last"])))
    pieces = ranked.select(key, F.posexplode(groups).alias("at", "c")).select(key, "at", "c.text", "c.tokens")

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            rows = [
                (k, at, i, t, n)
                for k, at, body, tokens in frame.itertuples(index=False)
                for i, (t, n) in enumerate(chunks_of(body, size) if tokens > size else [(body.strip(), tokens)])
                if t
            ]
            yield pd.DataFrame(rows, columns=[key, "at", "part", "text", "token_count"])

    cut = pieces.mapInPandas(whole, f"{key} bigint, at int, part int, text string, token_count int")
    place = F.row_number().over(Window.partitionBy(key).orderBy("at", "part")) - 1
    return cut.select(key, place.alias("chunk_index"), "text", "token_count")
