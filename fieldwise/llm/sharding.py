"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

Regions hold racks and racks hold shards.  A row descends the tree: at every level each
child draws ``-ln(u) / weight`` with ``u`` hashed from (key, child), the smallest draw wins,
and a child's weight is the sum of the weights below it.  A draw depends on its own child
alone, so a changed weight moves rows only into or out of that child's subtree.  A shard
that opens a branch of its own therefore takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

#: Runs of a shard that are numbered on their own; (shards x RUNS) is the size of the offsets.
RUNS = 1024
_MANTISSA = 1 << 53


@dataclass(frozen=True)
class Node:
    """A leaf has a shard number and a weight; an inner node has children."""

    name: str
    shard: int = -1
    own: float = 1.0
    children: tuple["Node", ...] = ()

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


def even_tree(shards: int, racks: int = 2, per_rack: int = 4) -> Node:
    """Shards 0 .. n-1 of equal weight, ``per_rack`` to a rack and ``racks`` to a region."""
    leaves = [Node(f"shard{s}", s) for s in range(shards)]
    tops = [
        Node(f"rack{i // per_rack}", children=tuple(leaves[i : i + per_rack]))
        for i in range(0, shards, per_rack)
    ]
    regions = [
        Node(f"region{i // racks}", children=tuple(tops[i : i + racks]))
        for i in range(0, len(tops), racks)
    ]
    return Node("root", children=tuple(regions))


def grown(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard in a region of its own; rows move only to that shard."""
    rack = Node(f"rack-of-{shard}", children=(Node(f"shard{shard}", shard, weight),))
    region = Node(f"region-of-{shard}", children=(rack,))
    return Node(tree.name, children=(*tree.children, region))


def _rows(tree: Node) -> list[tuple[int, list[tuple[str, float, int]]]]:
    """(shard, children as (name, weight, row)) of every node; the root is row 0."""
    nodes = [tree]
    for node in nodes:  # grows while it is read
        nodes.extend(node.children)
    at = {id(n): i for i, n in enumerate(nodes)}
    return [(n.shard, [(c.name, float(c.weight), at[id(c)]) for c in n.children]) for n in nodes]


def _depth(tree: Node) -> int:
    return 1 + max(map(_depth, tree.children)) if tree.children else 0


def shard_of(key: Column, tree: Node) -> Column:
    """Shard number of a key; only the children on the row's own path draw."""
    rows = _rows(tree)
    if any(weight <= 0 for _, children in rows for _, weight, _ in children):
        raise ValueError("weights must be positive")
    none = F.array().cast("array<struct<name:string,weight:double,row:int>>")
    kids = [
        F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"), F.lit(r).alias("row")) for n, w, r in c])
        if c else none for _, c in rows
    ]

    def draw(child: Column) -> Column:
        unit = F.pmod(F.xxhash64(key, child["name"]), F.lit(_MANTISSA)) + F.lit(0.5)
        return F.struct(-F.log(unit / F.lit(float(_MANTISSA))) / child["weight"], child["row"].alias("row"))

    at = F.lit(0)
    for _ in range(_depth(tree)):
        won = F.array_min(F.transform(F.get(F.array(*kids), at), draw))["row"]
        at = F.coalesce(won, at)  # a leaf stays where it is
    return F.get(F.array(*[F.lit(shard) for shard, _ in rows]), at)


def place(docs: DataFrame, tree: Node, more: Node, runs: int = RUNS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its shard, and its slot in the shard.

    ``size`` is the text's UTF-8 bytes (NULL: none) plus 8; ``text_crc32`` of a NULL text is
    that of no bytes, 0.  ``slot`` counts 0, 1, ... without gaps in each shard.  A NULL doc_id
    is a key like any other; rows with equal ids go to one shard and are told apart by size
    and checksum in the order of slots.  An empty table gives no rows.

    Slots need no task that sees a whole shard: every shard is cut into ``runs`` by a hash of
    doc_id, runs are numbered on their own, and the counts of the runs before (a table of
    shards x runs rows, whatever the input) give the offset.
    """
    ids = docs.select(
        "doc_id",
        shard_of(F.col("doc_id"), tree).cast("int").alias("shard"),
        F.pmod(F.xxhash64("doc_id", F.lit("run")), F.lit(runs)).cast("int").alias("run"),
    )
    counts = ids.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("shard").alias("o_shard"),
        F.col("run").alias("o_run"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
    )
    rows = docs.select(
        "doc_id",
        (F.octet_length(text_or_empty()) + 8).cast("bigint").alias("size"),
        F.crc32(F.encode(text_or_empty(), "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), tree).cast("int").alias("shard"),
        shard_of(F.col("doc_id"), more).cast("int").alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id", F.lit("run")), F.lit(runs)).cast("int").alias("run"),
    )
    run = Window.partitionBy("shard", "run").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("place", F.row_number().over(run).cast("bigint") - 1)
    # at most shards x runs rows of 16 bytes, by construction
    joined = numbered.join(
        F.broadcast(offsets),
        (F.col("shard") == F.col("o_shard")) & (F.col("run") == F.col("o_run")),
    )
    return joined.select(
        "doc_id", "size", "text_crc32", "law", "shard",
        (F.col("offset") + F.col("place")).alias("slot"), "grown_shard",
    )
