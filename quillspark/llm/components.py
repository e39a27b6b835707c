"""Connected components of a graph of links, as Spark jobs.

Each round first contracts: a task takes a bounded share of the edges, finds the
components among them and hooks every node to the smallest one of its own.  Where
all edges fit one such share, that is the answer.  Otherwise a large-star and a
small-star step follow: every node hooks its larger (then its smaller) neighbours
to the smallest node it knows.  Rounds go on until nothing changes.  A node that
very many link to only sends, per neighbour, one row, and its smallest neighbour
is found by a pre-aggregated minimum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, give_back, groups_for

#: Edges of one task's share: 16 bytes each, and a few times that while it works.
SHARE = 1 << 20


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b), sorted, and the smallest node that each can reach."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        open_ = p != q
        if not open_.any():
            return nodes, nodes[root]
        x, y, p, q = x[open_], y[open_], p[open_], q[open_]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    share = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if share:
        node, root = local_roots(*(np.concatenate(c) for c in zip(*share, strict=True)))
        moved = node != root
        yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(root[moved])], ["a", "b"])
        give_back()


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Neighbours of each node hooked to its smallest neighbour (or itself)."""
    near = _both(edges) if larger else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    hooked = near.join(low, "a")
    if larger:
        hooked = hooked.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        hooked = hooked.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
    return hooked.where("a <> b").distinct()


def components(links: DataFrame, scratch: Scratch, share: int = SHARE, most_rounds: int = 50) -> DataFrame:
    """(node, root) for every node that a link (a, b) touches, written; root is the smallest node reachable."""
    edges = scratch.cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    before = None
    for _ in range(most_rounds):
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (now["n"], now["s"]) == before:
            break
        before = (now["n"], now["s"])
        shares = groups_for(now["n"], share)
        nxt = edges.repartition(shares).mapInArrow(_contract, "a bigint, b bigint")
        nxt = scratch.cut(nxt if shares == 1 else _star(_star(nxt, True), False))
        scratch.drop(edges)
        edges = nxt
        if shares == 1:
            break
    else:
        raise RuntimeError("components did not settle")
    # Every edge now leads from a node to its root.
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
    roots = scratch.cut(roots)
    scratch.drop(edges)
    return roots
