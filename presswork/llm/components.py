"""Connected components: spanning forests in the tasks, then alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship

#: Edges that one task holds at a time; more are contracted in turn.
HELD_EDGES = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the graph with edges a-b; least nodes are left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def forest(edges: DataFrame) -> DataFrame:
    """edges (a, b: long), contracted in each task: never more than its nodes, and the
    same components. Each edge leads from a node to a smaller one."""

    def run(batches):
        held, size = [], 0

        def out():
            a, b = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(a, b)], ["a", "b"])

        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")])
            size += batch.num_rows
            if size >= HELD_EDGES:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    ship(edges.sparkSession)
    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): the smallest node of its component, for each node of `edges` (a, b:
    long, not null).

    A round first ties every larger neighbour of a node to the node's smallest one, then
    every smaller neighbour and the node itself. No step makes more edges than there were
    edges and nodes, so hubs cost rows, never squares of rows; minimums are partly made
    before each shuffle. Rounds go on until nothing changes and are written to the shared
    folder.
    """
    now = scratch.save(forest(edges.filter("a <> b")))
    seen = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        large = scratch.save(forest(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))))
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        tied = large.join(least, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        step = scratch.save(least.select("a", F.col("low").alias("b")).union(tied).distinct())
        scratch.drop(large)
        scratch.drop(now)
        now = step
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if state == seen:
            nodes = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
            return nodes.union(now.select("b", "b").distinct())
        seen = state
