"""Chunks of the sections that any extractor gives, each with its section's title.

Sections are rows (key, section, title, text).  Sentences, their windows and sections that fit are expressions and windows
over rows; only what is longer than a chunk may be goes through Python, to be cut into token windows.

Defined cases: a null or blank section has no chunks; a document without sections has none; a text without a sentence's end is one sentence;
repeated sections are chunks each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import tokens
from quillspark.functions.slices import bounds, give_back, slices
from quillspark.functions.strings import word_tokens

#: White space that is trimmed, and a sentence's end as a place between characters: its marks, closing marks and one blank.
BLANKS = " \t\n\r\x0b\x0c"
SENTENCE_END = r"(?<=[.!?][\"')\]]{0,64}\s)"


def bare(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def counted(rows: DataFrame, text: str, tokenizer: tokens.Tokenizer) -> DataFrame:
    """rows with the `token_count` of a text."""
    if tokenizer.name == tokens.WORDS.name:
        return rows.withColumn("token_count", word_tokens(F.col(text)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, text):
            yield frame.assign(token_count=[tokens.count(tokenizer, t) for t in frame[text]])

    return rows.mapInPandas(run, f"{_fields(rows)}, token_count int")


def _pieces(rows: DataFrame, size: int, overlap: int, tokenizer: tokens.Tokenizer, snap: bool = True) -> DataFrame:
    """rows with their text replaced by token windows of it; `i` numbers them and `start` says where they begin."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            cut = [tokens.windows(t, size, overlap, snap, tokenizer) for t in frame["text"]]
            again = frame.loc[frame.index.repeat([len(c) for c in cut])].reset_index(drop=True)
            yield again.assign(text=[t for c in cut for _, t in c], i=[i for c in cut for i in range(len(c))], start=[a for c in cut for a, _ in c])

    return rows.mapInPandas(run, f"{_fields(rows)}, i int, start int")


def _numbered(rows: DataFrame, key: str, tokenizer: tokens.Tokenizer) -> DataFrame:
    """key, chunk_index, title, text, token_count, embedded, in the order of section, place and i."""
    index = F.row_number().over(Window.partitionBy(key).orderBy("section", "place", "i")) - 1
    made = counted(rows.select(key, "section", "place", "i", "title", "text", "embedded"), "text", tokenizer)
    return made.select(key, index.alias("chunk_index"), "title", "text", "token_count", "embedded")


def by_heading(sections: DataFrame, size: int, overlap: int = 0, tokenizer: tokens.Tokenizer = tokens.WORDS, key: str = "doc_id") -> DataFrame:
    """A chunk for each section, however small; one that holds more than `size` tokens is cut."""
    rows = sections.select(key, "section", "title", bare(F.col("text")).alias("text"), F.lit(0).alias("place")).where("text <> ''")
    told = counted(rows, "text", tokenizer)
    fits = told.where(F.col("token_count") <= size).drop("token_count").withColumn("i", F.lit(0))
    cut = _pieces(told.where(F.col("token_count") > size).drop("token_count"), size, overlap, tokenizer).drop("start")
    return _numbered(fits.unionByName(cut).withColumn("embedded", F.col("text")), key, tokenizer)


def sentences(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, section, title, place, sentence: the sentences of each section, which tile its trimmed text."""
    parts = F.filter(F.split(bare(F.col("text")), SENTENCE_END), lambda s: s != "")
    return sections.select(key, "section", "title", F.posexplode(parts).alias("place", "sentence"))


def _cut_sentences(rows: DataFrame, size: int, tokenizer: tokens.Tokenizer) -> DataFrame:
    """rows (with `parts`, the sentences) and `cuts`: the token windows of each sentence of more than `size` tokens, none for others."""
    # Words are counted in SQL, as they are everywhere; other tokens where the sentence is cut.
    words = tokenizer.name == tokens.WORDS.name
    long = F.transform("parts", lambda s: (F.length(bare(s)) > size) & (word_tokens(bare(s)) > size if words else F.lit(True)))
    told = rows.withColumn("long", long)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at, end in bounds([sum(map(len, p)) for p in frame["parts"]]):
                cuts = []
                for parts, flags in zip(frame["parts"][at:end], frame["long"][at:end], strict=True):
                    cuts.append([])
                    for s, flag in zip(parts, flags, strict=True):
                        s = s.strip(BLANKS)
                        offsets = tokenizer.offsets(s) if flag else None
                        cut = flag and (words or len(offsets) - 1 > size)
                        cuts[-1].append([t for _, t in tokens.windows(s, size, 0, True, tokenizer, offsets)] if cut else [])
                yield frame[at:end].drop(columns="long").assign(cuts=cuts)
            give_back()

    return told.mapInPandas(run, f"{_fields(rows)}, cuts array<array<string>>")


def sentence_windows(sections: DataFrame, size: int, window: int = 3, tokenizer: tokens.Tokenizer = tokens.WORDS, key: str = "doc_id") -> DataFrame:
    """Each sentence (embedded) with up to `window` neighbours to either side in its section, as the text stands there.

    A sentence of more than `size` tokens has no window: it is cut, and each part stands for itself.  Windows are slices of a
    section's sentences.
    """
    listed = sections.select(key, "section", "title", bare(F.col("text")).alias("text"))
    parts = F.filter(F.split("text", SENTENCE_END), lambda s: s != "")
    # A token has a character at least, so only sections of more than `size` characters may hold a long sentence.
    short = listed.where(F.length("text") <= size).select(key, "section", "title", parts.alias("parts"), F.lit(None).cast("array<array<string>>").alias("cuts"))
    rows = short.unionByName(_cut_sentences(listed.where(F.length("text") > size).select(key, "section", "title", parts.alias("parts")), size, tokenizer))
    n = F.size(F.filter("parts", lambda s: bare(s) != "")) + F.aggregate(F.coalesce("cuts", F.array().cast("array<array<string>>")), F.lit(0), lambda a, c: a + F.greatest(F.size(c) - 1, F.lit(0)))
    # Sections are numbered before their windows are made, so what is dealt is the text once and not as often as windows hold it.
    begin = F.coalesce(F.sum(n).over(Window.partitionBy(key).orderBy("section").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    entry = lambda text, embedded: F.struct(text.alias("text"), embedded.alias("embedded"))

    def entries(sentence: Column, i: Column) -> Column:
        around = bare(F.array_join(F.slice("parts", F.greatest(i - window, F.lit(0)) + 1, F.least(i, F.lit(window)) + window + 1), ""))
        cut = F.get("cuts", i)
        none = F.array().cast("array<struct<text:string,embedded:string>>")
        return F.when(bare(sentence) == "", none).when(F.size(cut) > 0, F.transform(cut, lambda p: entry(p, p))).otherwise(F.array(entry(around, bare(sentence))))

    made = rows.withColumn("begin", begin).select(key, "title", "begin", F.posexplode(F.flatten(F.transform("parts", entries))).alias("at", "e"))
    made = made.select(key, (F.col("begin") + F.col("at")).cast("int").alias("chunk_index"), "title", "e.text", "e.embedded")
    return counted(made, "text", tokenizer).select(key, "chunk_index", "title", "text", "token_count", "embedded")


def whole(sections: DataFrame, size: int, overlap: int = 0, tokenizer: tokens.Tokenizer = tokens.WORDS, snap: bool = True, key: str = "doc_id") -> DataFrame:
    """Token windows over each document's sections, joined by blank lines; a chunk has the title of the section in which it begins."""
    rows = sections.select(key, "section", "title", bare(F.col("text")).alias("text")).where("text <> ''")
    joined = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("section", "title", "text"))).alias("s"))
    texts = F.transform("s", lambda x: x["text"])
    # Where each section begins in the joined text.
    begins = F.transform(F.sequence(F.lit(0), F.size("s") - 1), lambda k: F.aggregate(F.slice("s", 1, k), F.lit(0), lambda a, x: a + F.length(x["text"]) + 2))
    joined = joined.select(key, F.array_join(texts, "\n\n").alias("text"), F.arrays_zip(begins.alias("at"), F.transform("s", lambda x: x["title"]).alias("title")).alias("placed"))
    titles = joined.select(key, "placed")
    cut = _pieces(joined.select(key, "text"), size, overlap, tokenizer, snap).join(titles, key)
    title = F.element_at(F.filter("placed", lambda p: p["at"] <= F.col("start")), -1)["title"]
    return _numbered(cut.select(key, F.lit(0).alias("section"), F.lit(0).alias("place"), "i", title.alias("title"), "text", F.col("text").alias("embedded")), key, tokenizer)
