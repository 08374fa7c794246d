"""Connected components of a graph given by its edges, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise

#: edges that are contracted at a time where they are read
CHUNK = 1 << 19


def roots(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that edges (a, b) lead to, for each of ``m``."""
    root = np.arange(m)
    while len(a):
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        np.minimum.at(least, root, least)  # what one learns its old root learns, too
        least = least[least]
        if (least == root).all():
            break
        root = least
    return root


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of edges as stars around their smallest nodes."""

    def stars(chunk: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(k).to_numpy() for x in chunk]) for k in range(2))
        node, which = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = roots(len(node), *which.reshape(2, -1))
        at = np.flatnonzero(root != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[root[at]], pa.int64()), pa.array(node[at], pa.int64())], ["a", "b"])

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            yield stars(held)
            held, rows = [], 0
    if rows:
        yield stars(held)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the smallest node around it; ``moved`` where that isn't the node itself. Edges have a < b."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    m = F.least("a", "m")
    return edges.join(least, "a").select(m.alias("a"), "b", (m < F.col("a")).alias("moved"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of these; edges have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node of an edge (a, b) but those of self-loops alone.

    Edges are contracted where they are read, then stars alternate until every node's edge leads to its component's smallest; the
    rounds grow with the logarithm of the nodes. Each round is written to the shared folder, so a lost executor costs one at
    most. A star with very many nodes is joined, not collected; the joins' skew is Spark's to split.
    """
    now = materialise(edges.where("a <> b").select("a", "b").mapInArrow(_contract, "a bigint, b bigint"), "edges")
    settled = False
    while True:
        large = materialise(_large_star(now), "large-stars")
        if settled and large.where("moved").isEmpty():
            break
        now, settled = materialise(_small_star(large.select("a", "b")), "small-stars"), True
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
