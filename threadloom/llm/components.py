"""Connected components of an edge table, in alternating star rounds.

Tasks first contract the edges they hold by union-find, chunk by chunk. Then
every round points the neighbours of each node to the smallest of them
(larger neighbours first, then smaller ones) until nothing changes; paths
shrink by halves, so rounds grow with the logarithm of the longest path. A
node with very many neighbours is no problem: minima are summed up before the
shuffle, and the join back is an ordinary one that adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threadloom.session import discard, settle

EDGES_PER_CHUNK = 200_000


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges with the smallest node that it reaches, roots left out."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low < high
        if not apart.any():
            break
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def contract_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flushed() -> pa.RecordBatch:
        node, root = contracted(*(np.concatenate(x) for x in zip(*held)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["a", "b"])

    for batch in batches:
        held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
        if sum(len(x) for x, _ in held) >= EDGES_PER_CHUNK:
            yield flushed()
    if held:
        yield flushed()


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    joined = edges.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return joined.unionByName(low.select("a", F.col("low").alias("b"))).distinct()


def state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it reaches, for every node of the edges ``a``, ``b`` (longs).

    Edges may repeat, run either way or join a node to itself; null ends don't count.
    """
    edges = settle(edges.select("a", "b").where("a is not null and b is not null"), "edges")
    loops = edges.where("a = b").select(F.col("a").alias("node")).distinct()
    edges = settle(edges.where("a <> b").mapInArrow(contract_tasks, "a long, b long"), "edges")
    before = state(edges)
    while before[0]:
        # large_star gives edges from the larger to the smaller node, as small_star takes them.
        past, half = edges, settle(large_star(edges), "edges")
        edges = settle(small_star(half), "edges")
        discard(past, half)
        now = state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
    alone = loops.join(found, "node", "left_anti").withColumn("root", F.col("node"))
    return found.unionByName(alone)
