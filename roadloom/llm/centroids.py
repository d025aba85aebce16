"""Clustering around integer centroids with an incremental distance matrix.

The state is a table of vectors, each with its exact integer product with every centroid. When centroids move, a product
changes by the vector's components times the centroid's changes, and only where these are not zero: a round reads the last
table, adds those terms, takes the nearest centroid by |x|^2 - 2 x.c + |c|^2, and writes the next table. Clusters' sums are
added up by an aggregate that combines before its shuffle; so many rows as there are clusters come to the driver, which
holds the centroids and nothing else. A table in the shared folder ends the lineage of each round; two tables take turns, as
a round needs the last one only.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored

#: A component beyond this would let a squared distance leave 64 bits.
FARTHEST = 1 << 26
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def whole_vectors(vectors: DataFrame, dims: int = 64, factor: float = 1024.0) -> DataFrame:
    """vec_id, x (array<long>, floor(factor * component)) of the vectors that are kept."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == dims) & F.coalesce(fine, F.lit(False)))

    def whole(c):
        scaled = F.floor(c * factor)
        return F.when(F.abs(c * factor) <= float(FARTHEST), scaled).otherwise(F.raise_error(F.lit(f"a component times {factor} is beyond {FARTHEST}")).cast("long"))

    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("x"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of least sha256 of '<seed>:<vec_id>', in that order; repeated ids by their components, null ids last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = rows.select(key.alias("key"), "x").orderBy(F.col("key").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in chosen], dtype=np.int64)


def _products(state: DataFrame, changes: np.ndarray, squares: np.ndarray, fresh: bool) -> DataFrame:
    """state(vec_id, x, dots) after centroids moved by `changes`: products, nearest centroid and squared distance.

    fresh states have no products yet, so that changes are the centroids themselves.
    """
    moved = [np.flatnonzero(row) for row in changes]
    most = int(np.abs(changes).sum(axis=1).max()) if changes.size else 0
    if most * FARTHEST >= 1 << 62:
        raise OverflowError("centroids are too far for 64-bit products")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = batch.column(1).flatten().to_numpy().reshape(n, -1)
            dots = np.zeros((n, len(moved)), dtype=np.int64) if fresh else batch.column(2).flatten().to_numpy().reshape(n, -1).copy()
            for c, at in enumerate(moved):
                if len(at):
                    dots[:, c] += x[:, at] @ changes[c, at]
            distance = (x * x).sum(axis=1)[:, None] - 2 * dots + squares[None, :]
            cluster = distance.argmin(axis=1)
            held = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(moved), pa.int32()), pa.array(dots.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), held, pa.array(cluster, pa.int32()), pa.array(distance[np.arange(n), cluster])], names=["vec_id", "x", "dots", "cluster", "distance"])

    return state.mapInArrow(run, "vec_id long, x array<long>, dots array<long>, cluster int, distance long")


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid as its vectors' mean, rounded down component by component; those without vectors stay."""
    dims = centroids.shape[1]
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(dims)])
    out = centroids.copy()
    for r in sums.collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, factor: float = 1024.0, seed: int = 3) -> DataFrame:
    """vectors(vec_id long, embedding) -> vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, one row per kept vector.

    Vectors of exactly `dims` components, none null or not finite, are kept, and a component counts as floor(factor * x).
    Each round gives every vector to the nearest centroid (squared Euclidean distance, ties to the smaller number) and moves
    centroids to the means; after the last one vectors are given out once more. Rounds end early once no centroid moves,
    as all later ones would change nothing. Repeated rows count each; a null vec_id is clustered like any other but is the
    last choice for a first centroid. Fewer vectors than k give fewer centroids, and an empty table an empty result. Other
    columns are left out. A component beyond FARTHEST raises an error, as its squared distance would not fit 64 bits.
    """
    spark = vectors.sparkSession
    rows = stored(whole_vectors(vectors, dims, factor), "vectors")
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    changes, state = centroids, None
    turns = [scratch(spark, "products") for _ in range(2)]
    for done in range(rounds + 1):
        new_state = _products(rows if state is None else state, changes, (centroids * centroids).sum(axis=1), state is None)
        new_state.write.mode("overwrite").parquet(turns[done % 2])
        state = spark.read.schema(new_state.schema).parquet(turns[done % 2])
        if done == rounds:
            break
        new = _moved(state, centroids)
        changes, centroids = new - centroids, new
        if not changes.any():
            break
    inertia = [(r["cluster"], int(r["d"])) for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()]
    total = sum(d for _, d in inertia)
    table = [(c, d, total, sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, d in inertia]
    figures = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(figures), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
