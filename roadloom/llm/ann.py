"""Nearest neighbours by a block matrix join.

Of equal vectors, only the few of the smallest ids can be among a query's nearest, and the others are left out first, so
that a vector that a third of all rows hold costs what one costs. Vectors are quantised to int8 first: what is dealt into blocks and shuffled is a byte a component, a scale and the length of
what rounding leaves. Queries and candidates form blocks; each pair of blocks is one tile. In a tile, int8 products give
cosines with a bound on their error; a pair survives if its upper bound reaches the query's k-th best lower bound. A heap
per query merges the tiles' survivors, first within salted parts of a query's rows and then over all, and drops those below
the k-th best lower bound of all. Only what is left is joined with the vectors and computed in double precision, and a heap
takes the k best, so the result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, without
from .vectors import dot, lists_to_rows, running_dot, scaled, usable

#: Components whose int8 products a float32 adds exactly.
EXACT = 1024


class Quantised:
    """Unit vectors as int8 steps of a scale, and the length of what rounding leaves."""

    def __init__(self, steps: np.ndarray, scale: np.ndarray, error: np.ndarray):
        self.steps, self.scale, self.error = steps, scale, error

    @classmethod
    def of(cls, x: np.ndarray) -> Quantised:
        unit = x / np.sqrt(running_dot(x, x))[:, None]
        scale = np.abs(unit).max(axis=1) / 127
        steps = np.rint(unit / scale[:, None]).astype(np.int8)
        rest = unit - steps * scale[:, None]
        return cls(steps, scale, np.sqrt((rest * rest).sum(axis=1)) + 1e-12)


def bounds(q: Quantised, c: Quantised) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of all pairs from int8 products, which are added exactly, and bounds of their errors."""
    near = np.zeros((len(q.steps), len(c.steps)))
    for i in range(0, q.steps.shape[1], EXACT):
        near += q.steps[:, i : i + EXACT].astype(np.float32) @ c.steps[:, i : i + EXACT].astype(np.float32).T
    near *= q.scale[:, None]
    near *= c.scale[None, :]
    return near, q.error[:, None] * (1 + c.error[None, :]) + c.error[None, :]


def with_steps(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, v, is_query), v usable -> dim, vec_id, is_query, v, steps (binary), scale, error, digest; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = lists_to_rows(batch.column(1), np.float64)
            dims = np.array([len(r) for r in rows], dtype=np.int32)
            steps, scale, error = [b""] * len(rows), np.zeros(len(rows)), np.zeros(len(rows))
            digests = [blake2b(r.tobytes(), digest_size=16).digest() for r in rows]
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                q = Quantised.of(np.stack([rows[i] for i in at]))
                scale[at], error[at] = q.scale, q.error
                for i, s in zip(at, q.steps):
                    steps[i] = s.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(dims), *batch.select(["vec_id", "is_query", "v"]).columns, pa.array(steps, pa.binary()), pa.array(scale), pa.array(error), pa.array(digests, pa.binary())], names=["dim", "vec_id", "is_query", "v", "steps", "scale", "error", "digest"])

    return vectors.select("vec_id", "v", "is_query").mapInArrow(run, "dim int, vec_id long, is_query boolean, v array<double>, steps binary, scale double, error double, digest binary")


def beyond_the_first(rows: DataFrame, k: int) -> DataFrame:
    """copy of rows(digest, vec_id, copy) that are nobody's k nearest, as equal vectors of smaller ids go before them.

    A query leaves out its own id, so k + 1 ids of a vector stay, and of each id k rows.
    """
    by_id = Window.partitionBy("digest").orderBy("vec_id")
    of_id = Window.partitionBy("digest", "vec_id").orderBy("copy")
    kept = rows.select("digest", "vec_id", "copy").withColumn("n", F.row_number().over(of_id)).where(F.col("n") <= k)
    kept = kept.withColumn("r", F.dense_rank().over(by_id)).where(F.col("r") <= k + 1).select("copy")
    return rows.select("copy").join(kept, "copy", "left_anti")


class Tile:
    """Queries of a tile and their k best lower bounds so far; finds the survivors among more and more candidates."""

    def __init__(self, ids: np.ndarray, vectors: Quantised, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.low = np.full((len(ids), k), -np.inf)

    def survivors(self, ids: np.ndarray, numbers: np.ndarray, vectors: Quantised) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate's number, lower, upper) of pairs that reach the k-th best lower bound, a query's own id left out."""
        near, error = bounds(self.vectors, vectors)
        near[self.ids[:, None] == ids[None, :]] = -np.inf
        both = np.concatenate((self.low, near - error), axis=1)
        self.low = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
        up = near + error
        i, j = np.nonzero((up >= self.low.min(axis=1)[:, None]) & (up > -np.inf))
        return self.ids[i], numbers[j], near[i, j] - error[i, j], up[i, j]


def merged_bounds(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, low, up), a query's rows together -> those whose upper bound reaches the query's k-th best lower one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap, kept, limit = None, [], [], 1024

        def left():
            least = heap[0] if len(heap) == k else -np.inf
            return [r for r in kept if r[3] >= least]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["query_id", "vec_id", "low", "up"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if row[0] != now:
                    if now is not None:
                        yield batch_of(left())
                    now, heap, kept, limit = row[0], [], [], 1024
                if len(heap) < k:
                    heapq.heappush(heap, row[2])
                elif row[2] > heap[0]:
                    heapq.heapreplace(heap, row[2])
                if len(heap) < k or row[3] >= heap[0]:
                    kept.append(row)
                    if len(kept) > limit:
                        kept = left()
                        limit = max(1024, 2 * len(kept))
        if now is not None:
            yield batch_of(left())

    return rows.select("query_id", "vec_id", "low", "up").mapInArrow(run, "query_id long, vec_id long, low double, up double")


def best_by_heap(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score), a query's rows together -> query_id, rank, vec_id, score of its k best, ties to the smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap = None, []  # of (score, -vec_id), the worst on top

        def best():
            ranked = sorted(heap, reverse=True)
            columns = [pa.array([now] * len(ranked), pa.int64()), pa.array(range(1, len(ranked) + 1), pa.int32()), pa.array([-v for _, v in ranked], pa.int64()), pa.array([s for s, _ in ranked], pa.float64())]
            return pa.RecordBatch.from_arrays(columns, names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for query, vec, score in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if query != now:
                    if now is not None:
                        yield best()
                    now, heap = query, []
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec))
                elif (score, -vec) > heap[0]:
                    heapq.heapreplace(heap, (score, -vec))
        if now is not None:
            yield best()

    return rows.select("query_id", "vec_id", "score").mapInArrow(run, "query_id long, rank int, vec_id long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, query_block: int = 2048, block: int = 32_768, step: int = 1024, salts: int = 8) -> DataFrame:
    """vectors(vec_id long, embedding) -> query_id, rank, vec_id, score: the k nearest of each query row by cosine.

    Null, empty and zero vectors, those with null or non-finite components, and rows with a null vec_id take no part;
    components of any finite size do, as vectors are scaled by a power of two first, which changes no cosine. Vectors are
    compared with vectors of their own dimension. Rows that share the query's vec_id count as its own row, and repeated
    query rows as one; repeated candidate rows are candidates each. Fewer candidates than k give fewer rows; an empty table
    gives an empty result.
    """
    rows = vectors.where(usable("embedding") & F.col("vec_id").isNotNull()).select("vec_id", scaled("embedding").alias("v"), is_query.alias("is_query"))
    rows = stored(with_steps(rows).withColumn("copy", F.monotonically_increasing_id()), "vectors")
    near = without(rows, stored(beyond_the_first(rows, k), "copies"), ["copy"])
    n, m = rows.agg(F.count("*"), F.count_if("is_query")).first()
    blocks, query_blocks = -(-n // block) or 1, -(-m // query_block) or 1
    spread = lambda column, number: F.pmod(F.xxhash64(column), F.lit(number)).cast("int")
    every = lambda number: F.explode(F.sequence(F.lit(0), F.lit(number - 1)))
    asked = stored(rows.where("is_query").groupBy("dim", "vec_id").agg(F.min(F.struct("v", "steps", "scale", "error")).alias("q")).select("dim", "vec_id", "q.*"), "queries")
    queries = asked.select("dim", spread("vec_id", query_blocks).alias("qb"), every(blocks).alias("cb"), F.lit(0).alias("role"), "vec_id", F.lit(-1).cast("long").alias("copy"), "steps", "scale", "error")
    candidates = near.select("dim", every(query_blocks).alias("qb"), spread("copy", blocks).alias("cb"), F.lit(1).alias("role"), "vec_id", "copy", "steps", "scale", "error")
    tiles = queries.unionByName(candidates).repartition("dim", "qb", "cb").sortWithinPartitions("dim", "qb", "cb", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, tile = None, [], None

        def taken(batch, a, b):
            steps = np.frombuffer(b"".join(batch.column(6)[a:b].to_pylist()), dtype=np.int8).reshape(b - a, -1)
            return Quantised(steps, *(batch.column(i)[a:b].to_numpy() for i in (7, 8)))

        def joined(parts):
            return Quantised(*(np.concatenate([getattr(q, f) for q in parts]) for f in ("steps", "scale", "error")))

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(4)], axis=1)
            ids, copies = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges[:-1], edges[1:]):
                if key != tuple(keys[a, :3]):
                    key, parts, tile = tuple(keys[a, :3]), [], None
                if keys[a, 3] == 0:
                    parts.append((ids[a:b], taken(batch, a, b)))
                elif parts:
                    if tile is None:
                        tile = Tile(np.concatenate([i for i, _ in parts]), joined([q for _, q in parts]), k)
                    for s in range(a, b, step):
                        e = min(b, s + step)
                        q, c, low, up = tile.survivors(ids[s:e], copies[s:e], taken(batch, s, e))
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q, c, low, up)], names=["query_id", "vec_id", "low", "up"])

    # vec_id holds the candidate row's own number from here to the join that recomputes survivors.
    found = tiles.mapInArrow(run, "query_id long, vec_id long, low double, up double")
    found = found.withColumn("salt", spread("vec_id", salts)).repartition("query_id", "salt").sortWithinPartitions("query_id", "salt").drop("salt")
    found = merged_bounds(merged_bounds(found, k).repartition("query_id").sortWithinPartitions("query_id"), k).select("query_id", F.col("vec_id").alias("copy"))
    of_query = asked.select(F.col("vec_id").alias("query_id"), "dim", F.col("v").alias("q"))
    of_row = rows.select("copy", "vec_id", "dim", F.col("v").alias("c"))
    score = dot("q", "c") / (F.sqrt(dot("q", "q")) * F.sqrt(dot("c", "c")))
    pairs = found.join(of_row, "copy").join(of_query, ["query_id", "dim"]).select("query_id", "vec_id", score.alias("score"))
    return best_by_heap(pairs.repartition("query_id").sortWithinPartitions("query_id"), k)


def search_embeddings(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    return nearest(vectors.select("vec_id", "embedding"), F.col("vec_id") % every == 0, k)
