"""Connected components of links: distributed contraction, then one bounded union-find."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stages import stage

#: Links that one task settles (some 32 MB); more are contracted by joins until they are this few.
IN_TASK = 500_000


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of all nodes of the task's links; the label is the smallest node."""
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(parent.setdefault(a, a) and a), root(parent.setdefault(b, b) and b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for i in range(0, len(nodes), 10_000):
        part = nodes[i : i + 10_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.binary()), pa.array([root(x) for x in part], pa.binary())], ["node", "label"]
        )


def components(links: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """Written (node, label) of every node in ``links`` (a, b binary): equal labels in one component.

    While there are more links than one task may hold, every node moves to its smallest
    neighbour and links are redrawn between where their ends moved to; links within one place
    vanish.  A node with very many neighbours is reduced before the shuffle.  The few links
    that are left are settled in one task, and moves are followed back.
    """
    edges = stage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    moves = []
    while edges.count() > in_task:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moved = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select(
            "node", F.least("node", "near").alias("label")), "moves")
        moves.append(moved)
        to_a = moved.select(F.col("node").alias("a"), F.col("label").alias("x"))
        to_b = moved.select(F.col("node").alias("b"), F.col("label").alias("y"))
        redrawn = edges.join(to_a, "a").join(to_b, "b").filter("x != y")
        edges = stage(redrawn.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    labels = stage(edges.coalesce(1).mapInArrow(_roots, "node binary, label binary"), "labels")
    for moved in reversed(moves):
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        labels = stage(moved.join(far, "label", "left").select("node", F.coalesce("far", "label").alias("label")), "labels")
    return labels
