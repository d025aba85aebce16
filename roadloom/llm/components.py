"""Connected components: each task contracts its own edges, then large-star and small-star rounds (Kiveris et al., 2014) as joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, stored

#: A node of more edges than this is a hub, and no task gathers its edges; there are so many hubs at most.
LEAST_HUB, MOST_HUBS = 200, 100_000
#: Edges that one task contracts.
ROWS_PER_TASK = 200_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """edges(a long, b long) -> (node, component): component is the smallest node reachable.

    One row for each node that has an edge to another node; isolated nodes are not listed. Nulls and self-loops are
    dropped. Each task first turns its share of the edges into stars, which settles a graph of one share. Each round is
    written to the shared folder, so that lineage stays short; the edge set never grows beyond its first size. An empty
    input gives an empty result.
    """
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    e = stored(ends, "edges")
    tasks = -(-e.count() // ROWS_PER_TASK)
    if tasks <= 1:
        return _named(_stars(e.coalesce(1)))
    e = stored(_stars(e.repartition(tasks, "u")).distinct(), "stars")
    mark = _mark(e)
    for _ in range(max_rounds):
        hub = max(LEAST_HUB, 2 * mark[0] // MOST_HUBS)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
        large = _with(both.where("v > u"), least, hub).select(F.col("v").alias("u"), F.col("m").alias("v"))
        root = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with(large, root, hub).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v")
        e = stored(small.distinct(), "stars")
        last, mark = mark, _mark(e)
        if mark == last:
            return _named(e)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _named(stars: DataFrame) -> DataFrame:
    """Stars (u, v), v the smallest node of each component, as (node, component)."""
    nodes = stars.select(F.explode(F.array("u", "v")).alias("node"), F.col("v").alias("component"))
    return nodes.groupBy("node").agg(F.min("component").alias("component"))


def _stars(edges: DataFrame) -> DataFrame:
    """(u, v) of each partition as (u, v) from each node to the smallest that the partition's edges reach from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = root.setdefault(x, x)
            while root[top] != top:
                top = root[top]
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                u, v = find(u), find(v)
                if u != v:
                    root[max(u, v)] = min(u, v)
        rows = [(x, find(x)) for x in root if root[x] != x]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return edges.select("u", "v").mapInArrow(releasing(run), "u long, v long")


def _with(rows: DataFrame, table: DataFrame, hub: int) -> DataFrame:
    """rows(u, v) with m of table(u, m, n). Nodes of over hub rows are joined by broadcast: MOST_HUBS at most, as hub is chosen."""
    hubs = F.broadcast(table.where(F.col("n") > hub).select("u", "m"))
    others = table.where(F.col("n") <= hub).select("u", "m")
    return rows.join(hubs, "u").unionByName(rows.join(hubs.select("u"), "u", "left_anti").join(others, "u"))


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
