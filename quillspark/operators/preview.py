"""Several chunking configurations of the same documents side by side: what each would cut, from one reading of them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import tokens
from quillspark.functions.slices import slices
from quillspark.operators.retrieval import rank

#: Fixed value: configurations compared at a time.
MOST = 4
#: Fixed value: a chunk that ends with one of these ends with its sentence.
ENDINGS = tuple(".!?\"')]")


class Candidate(NamedTuple):
    name: str
    size: int
    overlap: int = 0
    snap: bool = True


def chunks(texts: DataFrame, candidates: tuple[Candidate, ...], tokenizer: tokens.Tokenizer = tokens.WORDS, key: str = "doc_id") -> DataFrame:
    """candidate, key, chunk_index, text, token_count, repeated of every candidate's chunks of texts (key, text).

    `repeated` counts the tokens that the chunk before holds as well.
    """
    if not 1 <= len(candidates) <= MOST or len({c.name for c in candidates}) < len(candidates):
        raise ValueError(f"one to {MOST} candidates with different names are compared")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            rows = []
            for k, t in frame.itertuples(index=False):
                # The text is read, moved, handed to Python and tokenized once for all candidates.
                offsets = tokenizer.offsets(t)
                for c in candidates:
                    end = 0
                    for i, (at, p) in enumerate(tokens.windows(t, c.size, c.overlap, c.snap, tokenizer, offsets)):
                        begin = t.find(p, at)
                        first, stop = np.searchsorted(offsets[:-1], (begin, end))
                        rows.append((c.name, k, i, p, tokens.count(tokenizer, p), max(0, int(stop - first))))
                        end = begin + len(p)
            yield pd.DataFrame(rows, columns=["candidate", key, "chunk_index", "text", "token_count", "repeated"])

    rows = texts.where(F.col("text").isNotNull()).select(F.col(key).cast("bigint").alias(key), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, f"candidate string, {key} bigint, chunk_index int, text string, token_count int, repeated int")


def compared(cut: DataFrame, candidates: tuple[Candidate, ...], key: str = "doc_id") -> DataFrame:
    """candidate and its distribution: chunks, low, median, p95, high, at_ceiling, mid_sentence, documents, tokens (what an embedder would read) and repeated (those of them that overlap adds).

    mid_sentence counts the chunks that end elsewhere than their sentence does; a document's last chunk ends with the document and isn't counted.
    `cut` is what `chunks` gave.  It is read once: a document's chunks of one count are a row first, and all else is told from such rows.
    """
    # Chunks come trimmed.
    open_ = (~F.substring("text", -1, 1).isin(*ENDINGS)).cast("int")
    each = cut.groupBy("candidate", key, "token_count").agg(F.count("*").alias("c"), F.sum(open_).alias("open"), F.max(F.struct("chunk_index", open_.alias("open"))).alias("last"), F.sum("repeated").alias("repeated"))
    document = Window.partitionBy("candidate", key)
    each = each.withColumns({"first": F.when(F.row_number().over(document.orderBy("token_count")) == 1, 1), "final": F.max("last").over(document)})
    mid = F.sum("open") - F.sum(F.when(F.col("first") == 1, F.col("final.open")).otherwise(0))
    hist = each.groupBy("candidate", "token_count").agg(F.sum("c").alias("c"), F.count("first").alias("documents"), mid.alias("mid"), F.sum("repeated").alias("repeated"))
    names = cut.sparkSession.createDataFrame([(c.name, int(0.9 * c.size)) for c in candidates], "candidate string, ceiling int")
    by = Window.partitionBy("candidate")
    run = hist.withColumn("upto", F.sum("c").over(by.orderBy("token_count"))).withColumn("n", F.sum("c").over(by))
    rows = F.broadcast(names).join(run, "candidate", "right").groupBy("candidate").agg(
        F.sum("c").alias("chunks"), F.min("token_count").alias("low"), rank("token_count", 0.5).alias("median"), rank("token_count", 0.95).alias("p95"), F.max("token_count").alias("high"),
        F.sum(F.when(F.col("token_count") >= F.col("ceiling"), F.col("c"))).alias("at_ceiling"), F.sum("mid").alias("mid_sentence"), F.sum("documents").alias("documents"), F.sum(F.col("token_count") * F.col("c")).alias("tokens"), F.sum("repeated").alias("repeated"),
    )
    some = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return names.join(rows, "candidate", "left").select("candidate", some("chunks"), "low", "median", "p95", "high", some("at_ceiling"), some("mid_sentence"), some("documents"), some("tokens"), some("repeated"))
