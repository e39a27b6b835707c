"""The memory pass: candidates of each user meet what is known, become facts or confirm one, retire others."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUTCOME = "end_user_id bigint, fact_id bigint, outcome string, of_fact bigint, confidence double"


def _unit(v) -> np.ndarray:
    """A vector of length 1; one without a length stays, and is like nothing."""
    v = np.asarray(v, float)
    n = np.sqrt(v @ v)
    return v / n if n else v


def reconcile(facts: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """What the pass does: rows of (end_user_id, fact_id, outcome, of_fact, confidence).

    facts: end_user_id, fact_id, embedding, confidence, live; candidates: end_user_id, candidate_id, place,
    embedding, confidence, supersedes (array of fact ids).  In order of place a candidate that is as similar as
    `threshold` to a fact written before in this pass, or else to the most similar fact (ties: the smaller id),
    confirms it if that one is live (`deduped`: its confidence rises); otherwise it is `inserted` and retires
    the user's open facts that it names (`superseded`, of_fact is the replacement).  A user's facts and
    candidates are bounded (the memory's budget and one reply), and depend on each other: one group a user.
    """

    def run(mine: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values("fact_id")
        ids = mine["fact_id"].to_numpy()
        # Facts of one vector are one row, with how many have it still and the smallest of them: what repeats is compared once.
        rows: dict[bytes, int] = {}
        units = [_unit(v) for v in mine["embedding"]]
        row_of = np.array([rows.setdefault(v.tobytes(), len(rows)) for v in units], int)
        vectors = np.array([np.frombuffer(b) for b in rows]) if rows else np.zeros((0, 1))
        owners: list[list[int]] = [[] for _ in rows]
        for i, row in zip(ids[::-1], row_of[::-1], strict=True):
            owners[row].append(int(i))
        place = dict(zip(map(int, ids), row_of, strict=True))
        gone: set[int] = set()
        first = np.array([o[-1] for o in owners], float)  # inf: no fact has the vector still
        known = {int(f): [float(c), bool(x)] for f, c, x in zip(ids, mine["confidence"], mine["live"], strict=True)}
        fresh: dict[int, np.ndarray] = {}
        out = []
        for c in new.sort_values(["place", "candidate_id"]).itertuples():
            v = _unit(c.embedding)
            same = next((f for f, x in fresh.items() if x @ v >= threshold), None)
            if same is None and np.isfinite(first).any():
                near = np.where(np.isfinite(first), vectors @ v, -2.0)
                best = near.max()
                same = int(first[near == best].min()) if best >= threshold else None
            if same is not None and known[same][1]:
                had = known[same][0]
                known[same][0] = min(1.0, max(had, had + (1 - had) / 3, float(c.confidence)))
                out.append((c.end_user_id, int(c.candidate_id), "deduped", same, known[same][0]))
                continue
            written = int(c.candidate_id)
            known[written] = [float(c.confidence), True]
            fresh[written] = v
            out.append((c.end_user_id, written, "inserted", None, float(c.confidence)))
            for old in dict.fromkeys(c.supersedes if c.supersedes is not None else []):
                if int(old) in known and known[int(old)][1] and int(old) != written:
                    known[int(old)][1] = False
                    if int(old) in place:  # a retired fact keeps its row and loses its vector
                        gone.add(int(old))
                        left = owners[place[int(old)]]
                        while left and left[-1] in gone:
                            left.pop()
                        first[place[int(old)]] = left[-1] if left else np.inf
                    fresh.pop(int(old), None)
                    out.append((c.end_user_id, int(old), "superseded", written, known[int(old)][0]))
        return pd.DataFrame(out, columns=[x.split()[0] for x in OUTCOME.split(", ")]).astype({"of_fact": "Int64"})

    # Own names for both sides: they may come from one table.
    mine, new = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (facts, candidates))
    return mine.groupBy("end_user_id").cogroup(new.groupBy("end_user_id")).applyInPandas(run, OUTCOME)


#: Fixed value: how many candidates a reply may hold.
MOST = 8
_FENCED = r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$"


def parsed(replies: DataFrame) -> DataFrame:
    """id, place, text, kind, confidence of the facts in model replies (id, reply): a JSON object with an array `facts`, maybe fenced.

    A reply that isn't such an object gives no rows.  Only the first MOST of the facts that have a text and a
    confidence from 0 to 1 are taken.
    """
    body = F.regexp_replace("reply", _FENCED, "$1")
    entries = F.from_json(F.get_json_object(body, "$.facts"), "array<struct<text:string,kind:string,confidence:double>>")
    each = replies.select("id", F.posexplode(entries).alias("i", "f")).where("trim(f.text) <> '' and f.confidence between 0 and 1")
    return each.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("i"))).where(F.col("place") <= MOST).select("id", "place", F.trim("f.text").alias("text"), "f.kind", "f.confidence")
