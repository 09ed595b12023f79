"""Connected components by alternating large-star and small-star steps, or in one task where all edges surely fit into
it; nothing is collected but counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, checkpoint

#: Edges that one task may take: 32 MB of pairs, where each round of stars would be some ten stages.
TASK_EDGES = 1 << 21


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge u-v with the least neighbour of u (or u itself) as m. The least ones are written out: both sides of the
    join are then shuffled, without which the skew join can't split a hot u."""
    least = checkpoint(edges.groupBy("u").agg(F.min("v").alias("m")))
    return edges.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _with_least(down)
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(linked.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, component) of edges(u, v), of which there are TASK_EDGES at most."""
    schema = pa.schema([("node", pa.int64()), ("component", pa.int64())])

    def run(batches):
        ends = [np.stack([c.to_numpy() for c in b.columns]) for b in batches]
        if not ends:
            return
        nodes, at = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
        u, v = at.reshape(2, -1)
        label = np.arange(len(nodes))
        while True:
            a, b = label[u], label[v]
            apart = a != b
            if not apart.any():
                break
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
        least = label == np.arange(len(nodes))
        nodes, label = nodes[~least], nodes[label[~least]]
        for start in range(0, len(nodes), 1 << 16):
            yield batch_of(schema, [nodes[start : start + (1 << 16)], label[start : start + (1 << 16)]])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "node bigint, component bigint")


def components(edges: DataFrame, max_rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component) for each node of edges(u, v) from which a lesser one is reachable; component is the least.

    Up to task_edges edges are one task's work. Beyond, rounds go on until the edge set no longer changes; each is cut
    by a checkpoint in the shared folder.
    """
    now = checkpoint(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        row = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (row.n, row.x) == mark or not row.n:
            break
        if mark is None and row.n <= task_edges:
            return _in_one_task(now)
        mark = (row.n, row.x)
        now = checkpoint(_small_star(_large_star(now)))
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
