"""What changed between two nested snapshots, field by field.

Both sides become rows of a path and a value: objects are opened level by level (a narrow step a level, as many as the deepest
snapshot has), arrays and plain values stay whole.  A full outer join of the two tables of rows tells what came, went and changed.

Defined cases: a field that is missing differs from one that holds null; 0 differs from false and 1 from 1.0; an empty object says nothing;
where one side holds an object and the other a plain value, the object's fields are compared with none; a snapshot that is null or no object has
no fields; keys with dots give paths that look alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Changes shown of one event, and characters shown of a value.
MOST_CHANGES, MOST_CHARS = 100, 500


def fields(snapshots: DataFrame, body: str) -> DataFrame:
    """id, path, value (variant), object of every field of the snapshots' JSON bodies."""
    spark = snapshots.sparkSession
    level = snapshots.select("id", F.lit("").alias("path"), F.try_parse_json(body).alias("value")).where("startswith(schema_of_variant(value), 'OBJECT')")
    out = None
    while not level.isEmpty():
        inner = spark.tvf.variant_explode(F.col("t.value").outer()).alias("e")
        path = F.when(F.col("t.path") == "", F.col("e.key")).otherwise(F.concat_ws(".", "t.path", "e.key"))
        opened = level.alias("t").lateralJoin(inner).select(F.col("t.id").alias("id"), path.alias("path"), F.col("e.value").alias("value"))
        opened = opened.withColumn("object", F.expr("startswith(schema_of_variant(value), 'OBJECT')"))
        out = opened if out is None else out.unionByName(opened)
        level = opened.where("object").drop("object")
    if out is None:
        return level.withColumn("object", F.lit(False))
    return out


def _kind(value: Column) -> Column:
    """Whole numbers, other numbers, and everything else by its own name."""
    name = F.schema_of_variant(value)
    return F.when(name.startswith("DECIMAL") | name.isin("DOUBLE", "FLOAT"), "number").otherwise(name)


def diff(before: DataFrame, after: DataFrame, body: str = "body", sensitive: tuple[str, ...] = ()) -> DataFrame:
    """id, place, path, change (added, removed, changed), before, after (JSON), truncated, omitted, in the order of paths.

    The first MOST_CHANGES of an id are shown, and `omitted` says how many more there are.  Values of `sensitive` paths are compared but not shown.
    """
    b, a = fields(before, body).alias("b"), fields(after, body).alias("a")
    both = b.join(a, F.expr("b.id <=> a.id and b.path = a.path"), "full_outer")
    rows = both.where("not coalesce(a.object, false) and not coalesce(b.object, false)").select(
        F.coalesce("b.id", "a.id").alias("id"), F.coalesce("b.path", "a.path").alias("path"), F.col("b.value").alias("x"), F.col("a.value").alias("y"), F.col("b.path").isNotNull().alias("was"), F.col("a.path").isNotNull().alias("is")
    )
    number = F.expr("try_variant_get(x, '$', 'double') <=> try_variant_get(y, '$', 'double')")
    same = (_kind(F.col("x")) == _kind(F.col("y"))) & F.when(_kind(F.col("x")) == "number", number).otherwise(F.to_json("x") == F.to_json("y"))
    rows = rows.where(~(F.col("was") & F.col("is") & same))
    change = F.when(~F.col("was"), "added").when(~F.col("is"), "removed").otherwise("changed")
    secret = F.col("path").isin(*sensitive) if sensitive else F.lit(False)
    shown = lambda c: F.when(secret & (F.to_json(c) != "null"), F.lit('"[redacted]"')).otherwise(F.to_json(c))
    rows = rows.select("id", "path", change.alias("change"), F.when(F.col("was"), shown("x")).alias("before"), F.when(F.col("is"), shown("y")).alias("after"))
    w = Window.partitionBy("id")
    placed = rows.withColumn("place", F.row_number().over(w.orderBy("path"))).withColumn("n", F.count("*").over(w)).where(F.col("place") <= MOST_CHANGES)
    long = lambda c: F.coalesce(F.length(c) > MOST_CHARS, F.lit(False))
    return placed.select("id", "place", "path", "change", F.substring("before", 1, MOST_CHARS).alias("before"), F.substring("after", 1, MOST_CHARS).alias("after"), (long("before") | long("after")).alias("truncated"), F.greatest(F.lit(0), F.col("n") - MOST_CHANGES).cast("int").alias("omitted"))
