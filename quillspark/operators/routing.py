"""Where a request goes and what it must know before: attempts in order, tokens of its messages, and whether they must be counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.strings import word_tokens
from quillspark.operators.memory import route

#: Fixed value: the mode that may try another target; any other one but ab_split has one target and no retry.
FAILOVER, SPLIT = "failover", "ab_split"


def attempts(requests: DataFrame, gateways: DataFrame, targets: DataFrame) -> DataFrame:
    """id, place (from 1), target, can_retry of requests (id, gateway_id, end_user_id); nothing where a gateway has no target.

    gateways: gateway_id, mode; targets: gateway_id, target, priority, weight.  ab_split takes the target into whose band the
    user falls, failover all of them by priority, and everything else, also a mode that is not known or null, the first one.
    """
    told = requests.join(F.broadcast(gateways.select("gateway_id", "mode")), "gateway_id")
    ranked = targets.withColumn("place", F.row_number().over(Window.partitionBy("gateway_id").orderBy("priority", "target")))
    failover = F.coalesce(F.col("mode") == FAILOVER, F.lit(False))
    split = F.coalesce(F.col("mode") == SPLIT, F.lit(False))
    ordered = told.where(~split).join(ranked, "gateway_id").where(failover | (F.col("place") == 1)).select("id", "place", "target", failover.alias("can_retry"))
    chosen = route(told.where(split).select("id", "gateway_id", "end_user_id"), targets)
    return ordered.unionByName(chosen.select("id", F.lit(1).alias("place"), "target", F.lit(False).alias("can_retry")))


def needs_estimate(limits: DataFrame) -> Column:
    """A limit on tokens applies: the gateway's own, or a user's if the request names one (gateway_tokens, user_tokens, end_user_id)."""
    return limits["gateway_tokens"].isNotNull() | (limits["user_tokens"].isNotNull() & limits["end_user_id"].isNotNull())


def prompt_tokens(messages: DataFrame, key: str) -> DataFrame:
    """key and tokens of all its messages (content); a null content has none."""
    return messages.groupBy(key).agg(F.sum(F.coalesce(word_tokens(F.col("content")), F.lit(0))).cast("bigint").alias("tokens"))


def audit_alerts(audits: DataFrame, connectors: DataFrame) -> DataFrame:
    """connector_id, name, kind, audit_id of the newest succeeded audit of each connector and kind, if its worst finding is red; not of connectors that are gone.

    audits: audit_id, connector_id, kind, created_at, status, severity; ties go to the larger id.
    """
    newest = audits.groupBy("connector_id", "kind").agg(F.max_by(F.struct("audit_id", "status", "severity"), F.struct("created_at", "audit_id")).alias("a"))
    return newest.where("a.status = 'succeeded' and a.severity = 'red'").join(connectors.select("connector_id", "name"), "connector_id").select("connector_id", "name", "kind", "a.audit_id")


#: Marks of byte order, the longer ones first, and what they declare.
BOMS = (("FFFE0000", "UTF-32LE"), ("0000FEFF", "UTF-32BE"), ("EFBBBF", "UTF-8"), ("FFFE", "UTF-16LE"), ("FEFF", "UTF-16BE"))


def decoded(data: Column) -> Column:
    """The text of bytes: a mark of byte order decides, else UTF-8; null where the bytes are neither."""
    rest = lambda n: F.substring(data, n + 1, 1 << 30)
    head = F.hex(F.substring(data, 1, 4))
    plain = F.when(F.is_valid_utf8(data.cast("string")), data.cast("string"))
    out = None
    for mark, name in BOMS:
        n = len(mark) // 2
        text = F.when(F.is_valid_utf8(rest(n).cast("string")), rest(n).cast("string")) if name == "UTF-8" else F.decode(rest(n), name)
        out = F.when(head.startswith(mark), text) if out is None else out.when(head.startswith(mark), text)
    return out.otherwise(plain)
