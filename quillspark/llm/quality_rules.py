"""Line-first cleaning with DataFrame functions only.

Every line is judged on its own: it must close with punctuation, must not be a
navigation line (short items with marks between them) or a symbol line, must not be
shouted and must not be boilerplate.
Lines that fail are removed, and a document that loses more than
`most_lost` percent of its word characters that way is rejected.

All of it is one projection over the scan: no shuffle, no Python.  Words repeated
in 3-word windows are found by hashing the windows into an array; only where two
hashes agree are they sorted together with their positions.  Windows are told apart by
64-bit hashes: in a text of N windows about N^2 / 2^65 unequal ones are taken for equal.

Defined cases: a null or empty text has no words, fails the base rules and its
cleaned text is empty; a line may have any number of words and items; repeated rows
give repeated results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
CLOSED = r"[.!?:;…\"'”»)\]][\x20\x09-\x0D]*$"
#: A navigation line: three or more items of at most 30 characters, none empty, with these marks between them.
MARKS, ITEM = "[|»›•·>]", 30
#: Phrases of page furniture; a line of at most 30 words that has one is boilerplate.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "enable javascript", "javascript is disabled", "privacy policy",
    "terms of service", "terms of use", "click here", "lorem ipsum", "sign up for", "subscribe to our",
    "skip to content", "back to top", "read more", "share this",
)


def _sql(pattern: str) -> str:
    """A pattern as a SQL literal."""
    return "r'" + pattern.replace("'", "\\x27") + "'"


def line_fails(line: str) -> str:
    """SQL condition under which a line (a SQL expression) is removed."""
    words = f"size(split({line}, {_sql(BLANK + '+')}))"
    marks = f"length(regexp_replace({line}, {_sql('[^#*$%&|<>]+')}, ''))"
    # The line is lowered once for all phrases.
    phrases = f"exists(array(lower({line})), x -> " + " or ".join(f"contains(x, '{p}')" for p in BOILERPLATE) + ")"
    # Items are cut and counted: a pattern with a repeated group would need a stack as deep as the line has items.
    items = f"transform(array(split({line}, '{MARKS}', -1)), i -> size(i) >= 3 and forall(i, x -> length(x) between 1 and {ITEM}))[0]"
    return (
        f"(not ({line} rlike {_sql(CLOSED)})"
        f" or ({line} rlike '{MARKS}' and {items})"
        f" or 4 * {marks} >= {words}"
        f" or ({line} = upper({line}) and {line} <> lower({line}) and {words} >= 3)"
        f" or ({words} <= 30 and ({phrases})))"
    )


def clean(docs: DataFrame, most_lost: int = 50, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_lines_removed, cleaned."""
    blank = _sql(BLANK)
    step = docs.select("doc_id", F.expr("coalesce(cast(text as string), '')").alias("t"))
    step = step.select(
        "doc_id",
        "t",
        F.expr(f"array_remove(split(t, {_sql(BLANK + '+')}), '')").alias("w"),
        F.expr(f"filter(split(t, '\\n'), l -> l rlike {_sql(BLANK.replace('[', '[^', 1))})").alias("lines"),
    )
    step = step.select(
        "doc_id",
        F.expr("bigint(size(w))").alias("n_words"),
        F.expr("bigint(length(array_join(w, '')))").alias("word_chars"),
        F.expr(f"bigint(length(regexp_replace(t, {_sql('[^#*$%&|<>]+')}, '')))").alias("n_symbols"),
        "lines",
        F.expr("bigint(size(lines) - size(array_distinct(lines)))").alias("n_dup_lines"),
        F.expr(
            "case when size(w) >= 3 then transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) else array() end"
        ).alias("h"),
        F.expr(f"filter(lines, l -> not {line_fails('l')})").alias("good"),
    )
    step = step.withColumn(
        "at",
        F.expr(
            "case when size(array_distinct(h)) < size(h) then array_sort(transform(h, (x, i) -> named_struct('x', x, 'i', i))) end"
        ),
    )
    step = step.withColumn(
        "at",
        F.expr(
            "case when at is not null then array_sort(transform(filter(at, (s, k) -> (k > 0 and at[greatest(k - 1, 0)].x = s.x)"
            " or (k + 1 < size(at) and at[least(k + 1, size(at) - 1)].x = s.x)), s -> s.i)) end"
        ),
    )
    step = step.withColumn(
        "n_repeat_words",
        F.expr(
            "coalesce(aggregate(transform(at, (p, k) -> case when k + 1 < size(at) then least(3, at[least(k + 1, size(at) - 1)] - p) else 3 end),"
            " 0L, (a, b) -> a + b), 0L)"
        ),
    )
    step = step.withColumn("cleaned", F.expr("array_join(good, '\\n')"))
    step = step.withColumn("base_failed", F.expr(f"n_words < {least_words} or 100 * n_repeat_words > {most_repeated} * n_words"))
    chars = f"length(regexp_replace(cleaned, {blank[:-1]}+', ''))"
    return step.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.expr(f"not base_failed and 100 * (word_chars - {chars}) <= {most_lost} * word_chars").alias("kept"),
        F.expr("bigint(size(lines))").alias("n_lines"),
        F.expr("bigint(size(lines) - size(good))").alias("n_lines_removed"),
        "cleaned",
    )


def _duck_fails(line: str) -> str:
    words = f"len(string_split_regex({line}, '[\\x20\\x09-\\x0D]+'))"
    phrases = " or ".join(f"contains(lower({line}), '{p}')" for p in BOILERPLATE)
    closed = CLOSED.replace("'", "\\x27").replace("$", "\\z")
    return (
        f"(not regexp_matches({line}, '{closed}')"
        f" or regexp_matches({line}, '^[^|»›•·>]{{1,30}}([|»›•·>][^|»›•·>]{{1,30}}){{2,}}\\z')"
        f" or 4 * length(regexp_replace({line}, '[^#*$%&|<>]+', '', 'g')) >= {words}"
        f" or ({line} = upper({line}) and {line} <> lower({line}) and {words} >= 3)"
        f" or ({words} <= 30 and ({phrases})))"
    )


SQL = f"""
with d as (
  select doc_id, row_number() over () as rid, coalesce(text, '') as t from documents
), w as (
  select *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as lines
  from d
), p as (
  select rid, i, w[i] as a, w[i + 1] as b, w[i + 2] as c
  from (select rid, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 3)
), r as (
  select rid, i from (select rid, i, count(*) over (partition by rid, a, b, c) as n from p) where n > 1
), n as (
  select rid, count(distinct j) as n_repeat_words
  from (select rid, unnest([i, i + 1, i + 2]) as j from r) group by rid
), s as (
  select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
    lines, list_filter(lines, lambda l: not {_duck_fails('l')}) as good
  from w left join n using (rid)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and
    100 * (word_chars - coalesce(length(regexp_replace(array_to_string(good, chr(10)), '[\\x20\\x09-\\x0D]+', '', 'g')), 0)) <= 50 * word_chars as kept,
  cast(len(lines) as bigint) as n_lines, cast(len(lines) - len(good) as bigint) as n_lines_removed
from s
"""
