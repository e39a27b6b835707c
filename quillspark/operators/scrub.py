"""Redaction of logged bodies by patterns that each gateway brings.

Every string in a JSON body is redacted, however deep it stands, and no key is; a body that is no JSON is one
string.  A pattern is used only if it is `safe`; the mark is the same for all.  The string literals of a body are cut out by
one pattern, so nesting needs no recursion.  Whole strings are redacted, without a bound on their length.

A body whose gateway has more than MOST_PATTERNS of them is not kept at all and marked as incomplete, as a partly redacted body
would look like a redacted one.  Defined cases: a null body stays null and is complete; no patterns change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what stands for a match.
REPLACEMENT = "[redacted]"
MOST_PATTERNS = 64
#: Places to which the bodies of one gateway are dealt.
SHARES = 256
#: A quantified group that holds a quantifier or a choice: such patterns may take exponential time, or a stack as deep as the text is long.
_UNSAFE = r"\([^()]*(?:[*+|]|\{\d*,)[^()]*\)[*+{]"
_LITERAL = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*+:?'


def safe(pattern: Column) -> Column:
    """The pattern is neither blank nor of a shape that backtracks without end."""
    return (F.trim(pattern) != "") & ~pattern.rlike(_UNSAFE)


def redacted(text: Column, patterns: Column) -> Column:
    return F.aggregate(patterns, text, lambda t, p: F.regexp_replace(t, p, F.lit(REPLACEMENT)))


def scrubbed(bodies: DataFrame, gateways: DataFrame) -> DataFrame:
    """bodies with `body` redacted and `complete`; bodies: gateway_id, body, any other columns; gateways: gateway_id, patterns (array)."""
    usable = F.filter(F.coalesce("patterns", F.expr("cast(array() as array<string>)")), lambda p: F.coalesce(safe(p), F.lit(False)))
    # A few gateways may have all the bodies: each gateway's are dealt to SHARES places, and its patterns go to all of them.
    share = F.pmod(F.xxhash64("body"), F.lit(SHARES)).cast("int")
    every = gateways.select("gateway_id", usable.alias("_patterns"), F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("_share"))
    rows = bodies.withColumn("_share", share).join(every, ["gateway_id", "_share"], "left").drop("_share")
    some = F.coalesce(F.size("_patterns"), F.lit(0)) > 0
    is_json = F.ltrim("body").rlike(r"^[\[{\x22]") & F.try_parse_json("body").isNotNull()
    # The parts between string literals stay; a literal before a colon is a key.
    both = F.arrays_zip(F.split("body", f"(?s){_LITERAL}", -1).alias("kept"), F.regexp_extract_all(F.col("body"), F.lit(f"(?s){_LITERAL}"), F.lit(0)).alias("taken"))

    def value(literal: Column) -> Column:
        said = F.from_json(F.concat(F.lit("["), literal, F.lit("]")), "array<string>")[0]
        shown = F.to_json(F.array(redacted(said, F.col("_patterns"))))
        return F.substring(shown, F.lit(2), F.length(shown) - 2)

    each = F.transform(both, lambda x: F.concat(x["kept"], F.when(x["taken"].isNull(), "").when(x["taken"].endswith(":"), x["taken"]).otherwise(value(F.rtrim(x["taken"])))))
    body = F.when(~some, F.col("body")).when(is_json, F.array_join(each, "")).otherwise(redacted(F.col("body"), F.col("_patterns")))
    complete = F.coalesce(F.size("_patterns"), F.lit(0)) <= MOST_PATTERNS
    return rows.withColumn("complete", complete | F.col("body").isNull()).withColumn("body", F.when(complete, body)).drop("_patterns")
