"""Centroid clustering with a LAESA pivot table.

The distances of every vector to a few fixed pivots are computed once and stored beside it.
In each round the centroids' distances to the same pivots give, by the triangle inequality,
    |d(x, p) - d(c, p)| <= d(x, c)    for every pivot p,
so only centroids whose bound does not pass the distance to the most promising one receive an
exact integer distance.  All decisions rest on exact integers; bounds only spare work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stages import stage

SCALE, PARTS, CLUSTERS, ROUNDS = 64, 64, 16, 3
PIVOTS = 6
#: Components must stay below this, so that a squared distance fits a long.
LARGEST = 1 << 27
#: Vectors that are worked on at a time.
CHUNK = 4096
#: The bounds come from rounded square roots; they are lowered by this share of the larger root.
SLACK = 1e-9


def usable(embedding: str = "embedding") -> Column:
    """Exactly PARTS components, none of them NULL, NaN or infinite."""
    v = F.col(embedding)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == PARTS) & finite


def components(embedding: str = "embedding") -> Column:
    """floor(SCALE * x) of each component."""
    return F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two equally long matrices."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def pivots_of(vectors: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Base prototypes: each next one is the farthest, in total, from those before."""
    if not len(vectors):
        return vectors
    chosen, total = [0], np.zeros(len(vectors))
    while len(chosen) < min(most, len(vectors)):
        total += np.sqrt(_squared(vectors, vectors[chosen[-1]][None, :]).astype(float))
        total[chosen] = -1.0
        chosen.append(int(np.argmax(total)))
    return vectors[chosen]


def roots_to(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of vectors (rows) to pivots (columns)."""
    return np.stack([np.sqrt(_squared(vectors, p[None, :]).astype(float)) for p in pivots], axis=1)


def nearest(vectors: np.ndarray, table: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of and squared distance to the nearest centroid, and how many distances it took.

    ``table`` holds the vectors' distances to the pivots.  Ties go to the smaller number.
    """
    from_pivots = roots_to(centroids, pivots)
    bound = np.zeros((len(vectors), len(centroids)))
    for p in range(len(pivots)):
        a, b = table[:, p, None], from_pivots[None, :, p]
        np.maximum(bound, np.abs(a - b) - SLACK * np.maximum(a, b), out=bound)
    first = bound.argmin(axis=1)
    rows = np.arange(len(vectors))
    exact = np.full(bound.shape, np.iinfo(np.int64).max)
    exact[rows, first] = _squared(vectors, centroids[first])
    reach = np.sqrt(exact[rows, first].astype(float)) * (1 + SLACK)
    survives = bound <= reach[:, None]
    survives[rows, first] = False
    i, c = np.nonzero(survives)
    exact[i, c] = _squared(vectors[i], centroids[c])
    best = exact.argmin(axis=1)
    return best, exact[rows, best], len(vectors) + len(i)


def _with_pivots(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                piece = batch.slice(at, CHUNK)
                table = roots_to(_matrix(piece.column(1)), pivots)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(table.ravel()), len(pivots))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), lists.cast(pa.list_(pa.float64()))], ["vec_id", "v", "table"]
                )

    return run


def _assigned(piece: pa.RecordBatch, centroids: np.ndarray, pivots: np.ndarray):
    vectors = _matrix(piece.column(1))
    table = piece.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    return vectors, *nearest(vectors, table, centroids, pivots)


def _totals(centroids: np.ndarray, pivots: np.ndarray):
    """One row per cluster and task: members and sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        count, sums = np.zeros(k, np.int64), np.zeros((k, PARTS), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                vectors, best, _, _ = _assigned(batch.slice(at, CHUNK), centroids, pivots)
                count += np.bincount(best, minlength=k)
                for c in np.unique(best):
                    sums[c] += vectors[best == c].sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(k), PARTS), pa.int32()), pa.array(np.tile(np.arange(PARTS), k), pa.int32()),
             pa.array(np.repeat(count, PARTS)), pa.array(sums.ravel())], ["cluster", "part", "n", "s"],
        )

    return run


def _labels(centroids: np.ndarray, pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                piece = batch.slice(at, CHUNK)
                _, best, squared, _ = _assigned(piece, centroids, pivots)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(best, pa.int32()), pa.array(squared)], ["vec_id", "cluster", "distance"]
                )

    return run


def clusters(embeddings: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each usable vector.

    ``embeddings`` (vec_id long, embedding array of numbers): see usable() for what is kept; the
    rest has no row.  Starts are the kept vectors with the CLUSTERS smallest sha256 of
    ``1:<vec_id>`` (a NULL id counts as no digits; equal ids in the order of their components);
    fewer vectors make fewer clusters, none make no rows.  A component of LARGEST or more after
    scaling is refused, as its squared distance may pass 64 bits.  Repeated rows are rows.

    The driver holds the centroids (CLUSTERS rows) and nothing that grows with the table.
    """
    spark = embeddings.sparkSession
    small = F.forall("embedding", lambda x: F.abs(x.cast("double")) < LARGEST / SCALE)
    refused = F.raise_error(F.lit(f"a component of {LARGEST / SCALE:.0f} or more")).cast("array<int>")
    v = F.when(small, components().cast("array<int>")).otherwise(refused)
    kept = stage(embeddings.filter(usable()).select("vec_id", v.alias("v")), "vectors")
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    starts = kept.orderBy(key, "v").limit(CLUSTERS).collect()
    out = "vec_id long, cluster int, distance long"
    if not starts:
        return spark.createDataFrame([], out + ", cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r.v for r in starts], np.int64)
    pivots = pivots_of(centroids)
    rows = stage(kept.mapInArrow(_with_pivots(pivots), "vec_id long, v array<int>, table array<double>"), "pivots")
    for _ in range(ROUNDS):
        totals = rows.mapInArrow(_totals(centroids, pivots), "cluster int, part int, n long, s long")
        means = totals.groupBy("cluster", "part").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).filter("n > 0")
        centroids = centroids.copy()
        for r in means.collect():  # CLUSTERS x PARTS rows
            centroids[r.cluster, r.part] = r.s // r.n
    labelled = stage(rows.mapInArrow(_labels(centroids, pivots), out), "labels")
    per_cluster = labelled.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    inertia = sum(r.cluster_inertia for r in per_cluster)
    named = spark.createDataFrame(
        [(r.cluster, r.cluster_inertia, inertia, ",".join(map(str, centroids[r.cluster].tolist()))) for r in per_cluster],
        "c_cluster int, cluster_inertia long, inertia long, centroid string",
    ).withColumn("centroid_sha256", F.sha2("centroid", 256)).drop("centroid")
    return labelled.join(F.broadcast(named), F.col("cluster") == F.col("c_cluster")).drop("c_cluster")  # CLUSTERS rows
