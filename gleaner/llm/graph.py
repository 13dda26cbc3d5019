"""Connected components of a graph of documents, by alternating stars on tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import store


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Hang each node's neighbours (larger ones, or smaller ones and itself) on its least one."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    hung = pairs.join(least, "u")
    if larger_only:
        return hung.where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    hung = hung.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")


def _contracted(edges: DataFrame) -> DataFrame:
    """Stars of each partition's own components, a bounded number of edges at a time."""

    def run(batches):
        for batch in batches:
            a, b = (batch.column(i).to_numpy() for i in (0, 1))
            nodes, places = np.unique(np.concatenate((a, b)), return_inverse=True)
            x, y = places[: len(a)], places[len(a) :]
            root = np.arange(len(nodes))
            while len(x):
                low = np.minimum(root[x], root[y])
                np.minimum.at(root, root[x], low)
                np.minimum.at(root, root[y], low)
                while (root[root] != root).any():
                    root = root[root]
                apart = root[x] != root[y]
                x, y = x[apart], y[apart]
            own = root != np.arange(len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["u", "v"])

    return edges.mapInArrow(run, "u bigint, v bigint")


def _is_done(state: DataFrame) -> bool:
    """Whether each node hangs on one other, and that on none: nothing would move any more."""
    ends = state.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        state.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    sums = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` of the nodes of ``edges (a, b)``; the component is its least node.

    A round is two joins on nodes, and rounds grow with the logarithm of the nodes; if ``rounds`` are not
    enough this raises.  The minima are found with partial aggregation, and the
    tasks of a node with very many neighbours are split by adaptive execution.
    """
    state = store(_contracted(edges.select("a", "b").where("a <> b")), "edges")
    for _ in range(rounds):
        large = _star(_both(state), True)
        state = store(_star(large, False).distinct(), "edges")
        if _is_done(state):
            break
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
