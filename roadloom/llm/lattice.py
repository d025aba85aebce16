"""Embedding near-duplicates by E8 lattice hashing.

Unit vectors are projected at random to a few times eight dimensions, scaled, shifted, and each eight are decoded to the
nearest point of the E8 lattice; the points of a table name the vector's cell. Every vector also visits the neighbouring
cells that it is closest to. Pairs that meet in a cell are verified by their cosine in double precision. Links are counted
where a pair meets first, in a fixed order of tables and ways to meet, so nothing has to be removed afterwards and pairs
are never written: a task sends counts per vector and the edges of a spanning forest.

Equal vectors are one row before hashing. A cell with many vectors is split into blocks that all its vectors visit, so no
cell is capped and none is held whole. The random rotation is fixed by ``seed`` and the vectors' dimension.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import connected_components
from .vectors import lists_to_rows, scaled, usable

TABLES, BLOCKS, PROBES, SCALE = 6, 2, 2, 0.36


@lru_cache(maxsize=1)
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    pairs = [v for i, j in combinations(range(8), 2) for a, b in product((1, -1), repeat=2) for v in [[a if k == i else b if k == j else 0 for k in range(8)]]]
    halves = [s for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(pairs + [list(h) for h in halves])


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of an even sum."""
    z = np.rint(y)
    off = y - z
    odd = np.flatnonzero(z.sum(axis=1) % 2 != 0)
    worst = np.argmax(np.abs(off[odd]), axis=1)
    z[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return z


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """The nearest E8 point to each row of eight: of D8 or of D8 shifted by one half."""
    a, b = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


def _mix(points: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit name for each row of lattice coordinates."""
    h = np.full(len(points), salt * 2 + 1, dtype=np.uint64)
    for c in np.rint(points * 2).astype(np.int64).astype(np.uint64).T:
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.astype(np.int64)


@lru_cache(maxsize=8)
def _rotation(dim: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((TABLES, dim, 8 * BLOCKS)) / np.sqrt(dim) / SCALE, rng.uniform(0, 1, (TABLES, 8 * BLOCKS))


def cells(x: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(n x TABLES) own cells and (n x TABLES x PROBES) neighbouring cells of unit vectors."""
    n, dim = x.shape
    turn, shift = _rotation(dim, seed)
    own = np.empty((n, TABLES), dtype=np.int64)
    near = np.empty((n, TABLES, PROBES), dtype=np.int64)
    for t in range(TABLES):
        y = x @ turn[t] + shift[t]
        z = np.concatenate([nearest_e8(y[:, 8 * b : 8 * b + 8]) for b in range(BLOCKS)], axis=1)
        salt = (dim << 8) + t
        own[:, t] = _mix(z, salt)
        # The neighbours over one root of one block, by the distance that they add.
        gain = np.concatenate([(y - z)[:, 8 * b : 8 * b + 8] @ roots().T for b in range(BLOCKS)], axis=1)
        best = np.argpartition(-gain, PROBES, axis=1)[:, :PROBES]
        for p in range(PROBES):
            w = z.copy()
            block = best[:, p] // 240
            for b in range(BLOCKS):
                w[:, 8 * b : 8 * b + 8] += np.where((block == b)[:, None], roots()[best[:, p] % 240], 0)
            near[:, t, p] = _mix(w, salt)
    return own, near


def _met_before(own_a, near_a, own_b, near_b, table: int, way: int) -> np.ndarray:
    """Whether pairs (a has the smaller id) meet in an earlier table, or in this one in an earlier way: 0 one cell, 1 b visits a, 2 a visits b."""
    out = np.zeros(len(own_a), dtype=bool)
    for t in range(table + 1):
        for w in range(3 if t < table else way):
            if w == 0:
                out |= own_a[:, t] == own_b[:, t]
            elif w == 1:
                out |= (near_b[:, t] == own_a[:, t, None]).any(axis=1)
            else:
                out |= (near_a[:, t] == own_b[:, t, None]).any(axis=1)
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links (a, b): node and the component's smallest node."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


class _Cell:
    """The vectors of one block of one cell, and the links between them and its visitors."""

    def __init__(self, key, threshold):
        self.key, self.threshold, self.parts, self.rows = key, threshold, [], None

    def links(self, role: int, ids, n, x, own, near):
        """(id, count) of links and (node, root) of a forest, for rows that visit."""
        if self.rows is None:
            self.rows = [np.concatenate(c) for c in zip(*self.parts)] if self.parts else None
        if self.rows is None:
            return None
        r_ids, r_n, r_x, r_own, r_near = self.rows
        i, j = np.nonzero(x @ r_x.T >= self.threshold)
        first = ids[i] < r_ids[j]
        keep = ids[i] != r_ids[j]
        if role < 2:
            # Members of the cell meet both ways round: each is counted as a visitor of the other.
            i, j = i[keep], j[keep]
            first = first[keep]
            way = np.zeros(len(i), dtype=int)
        else:
            i, j, first = i[keep], j[keep], first[keep]
            way = np.where(first, 2, 1)
        if not len(i):
            return None
        swap = lambda a, b: (np.where(first.reshape(-1, *[1] * (a.ndim - 1)), a, b), np.where(first.reshape(-1, *[1] * (a.ndim - 1)), b, a))
        (own_a, own_b), (near_a, near_b) = swap(own[i], r_own[j]), swap(near[i], r_near[j])
        new = np.ones(len(i), dtype=bool)
        for w in np.unique(way):
            m = way == w
            new[m] = ~_met_before(own_a[m], near_a[m], own_b[m], near_b[m], self.key[0], int(w))
        i, j = i[new], j[new]
        if not len(i):
            return None
        who, count = ids[i], r_n[j]
        if role == 2:
            who, count = np.concatenate((who, r_ids[j])), np.concatenate((count, n[i]))
        names, at = np.unique(who, return_inverse=True)
        return names, np.bincount(at, weights=count).astype(np.int64), *_forest(ids[i], r_ids[j])


def embedding_links(vectors: DataFrame, threshold: float = 0.95, seed: int = 7, cell_block: int = 1024) -> DataFrame:
    """vectors(vec_id long, embedding) -> vec_id, n_links, component_id, kept, one row per row.

    Vectors that are null, empty or zero or hold null or non-finite components, and rows with a null vec_id, link with
    nothing: n_links 0, their own component. Vectors of different dimensions are never linked. Repeated rows are vectors of
    their own. Components of any finite size take part: vectors are scaled by a power of two first. An empty table gives an
    empty result.
    """
    fit = usable("embedding") & F.col("vec_id").isNotNull()
    rows = stored(vectors.select("vec_id", F.when(fit, scaled("embedding")).alias("v")), "embeddings")
    groups = stored(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "vector_classes")

    def hashed(batches):
        for batch in batches:
            vs = lists_to_rows(batch.column(0), np.float64)
            dims = np.array([len(v) for v in vs])
            for dim in np.unique(dims):
                pick = np.flatnonzero(dims == dim)
                for s in range(0, len(pick), 4096):
                    part = pick[s : s + 4096]
                    x = np.stack([vs[i] for i in part])
                    x /= np.sqrt((x * x).sum(axis=1))[:, None]
                    own, near = cells(x, seed)
                    take = pa.array(part)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(1).take(take), batch.column(2).take(take), pa.array(list(x), pa.list_(pa.float64())), pa.array(list(own), pa.list_(pa.int64())), pa.array(list(near.reshape(len(part), -1)), pa.list_(pa.int64()))],
                        names=["id", "n", "x", "own", "near"],
                    )

    signed = stored(groups.mapInArrow(hashed, "id long, n long, x array<double>, own array<long>, near array<long>"), "cells")
    members = signed.select(F.posexplode("own").alias("table", "cell"), "id")
    crowded = members.groupBy("table", "cell").agg(F.count("*").alias("_n")).where(F.col("_n") > cell_block).select("table", "cell", F.ceil(F.col("_n") / cell_block).cast("int").alias("parts"))
    spread = F.pmod(F.xxhash64("id", F.lit(1)), F.coalesce("parts", F.lit(1))).cast("int")
    every = F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)
    occupied = members.select("table", "cell").distinct().join(crowded, ["table", "cell"], "left")
    own = members.join(crowded, ["table", "cell"], "left").withColumn("mine", spread)
    own = own.select("*", F.explode(every).alias("part")).withColumn("role", F.when(F.col("part") == F.col("mine"), 0).otherwise(1))
    visits = signed.select("id", F.posexplode("near").alias("slot", "cell")).withColumn("table", F.floor(F.col("slot") / PROBES).cast("int"))
    # Only cells that hold someone are visited. Vectors join once it is known where they go.
    visits = visits.join(occupied, ["table", "cell"]).select("*", F.explode(every).alias("part"), F.lit(2).alias("role"))
    places = ["table", "cell", "part", "role", "id"]
    met = own.select(places).unionByName(visits.select(places)).join(signed, "id").select(*places, "n", "x", "own", "near")
    met = met.repartition("table", "cell", "part").sortWithinPartitions("table", "cell", "part", "role")

    def verify(batches):
        now: _Cell | None = None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in range(4)], axis=1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            ids, n = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            flat = [batch.column(c).flatten().to_numpy() for c in (6, 7, 8)]
            begins = [np.concatenate(([0], np.cumsum(batch.column(c).value_lengths().to_numpy()))) for c in (6, 7, 8)]
            counts, nodes = ([], []), ([], [])
            for a, b in zip(edges[:-1], edges[1:]):
                role = int(key[a, 3])
                if now is None or now.key != tuple(key[a, :3].tolist()):
                    now = _Cell(tuple(key[a, :3].tolist()), threshold)
                if role == 0 and b - a == 1 and b < len(key) and key[b, 3] == 0 and not now.parts:
                    continue  # alone in its cell, and nobody visits
                x, own, near = (f[p[a] : p[b]].reshape(b - a, -1) for f, p in zip(flat, begins))
                part = (ids[a:b], n[a:b], x, own, near.reshape(b - a, TABLES, PROBES))
                if role == 0:
                    # Members that came in an earlier batch meet those of this one both ways.
                    for old in list(now.parts):
                        for mine, other in ((part, old), (old, part)):
                            _add(_pairs(now, 1, mine, other), counts, nodes)
                    now.parts.append(part)
                    _add(_pairs(now, 0, part, part), counts, nodes)
                else:
                    for s in range(0, b - a, 2048):
                        _add(now.links(role, *(c[s : s + 2048] for c in part)), counts, nodes)
            yield from _out(counts, nodes)

    found = met.mapInArrow(verify, "a long, b long, count long")
    found = stored(found, "links")
    edges = found.where("b is not null").select("a", "b")
    labels = connected_components(edges)
    counted = found.where("count is not null").groupBy(F.col("a").alias("id")).agg(F.sum("count").alias("_links"))
    named = groups.join(counted, "id", "left").join(labels, F.col("id") == F.col("node"), "left").select("v", F.col("n").alias("_copies"), F.coalesce("_links", F.lit(0)).alias("_links"), F.coalesce("component", "id").alias("_root"))
    out = rows.join(named, "v", "left")
    root = F.coalesce("_root", "vec_id")
    return out.select("vec_id", (F.coalesce("_links", F.lit(0)) + F.coalesce(F.col("_copies") - 1, F.lit(0))).alias("n_links"), root.alias("component_id"), F.coalesce(F.col("vec_id") == root, F.lit(False)).alias("kept"))


def _pairs(cell: _Cell, role: int, visitors: tuple, members: tuple):
    one = _Cell(cell.key, cell.threshold)
    one.parts = [members]
    return one.links(role, *visitors)


def _add(got, counts, nodes):
    if got:
        for out, c in zip((*counts, *nodes), got):
            out.append(c)


def _out(counts, nodes):
    for (a, b), is_count in ((counts, True), (nodes, False)):
        if a:
            ids, other = np.concatenate(a), pa.array(np.concatenate(b))
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids), none if is_count else other, other if is_count else none], names=["a", "b", "count"])
