"""Hard negatives of labelled vectors by Kronecker-packed products.

Components are integers. A block of candidates is biased so that none is negative, and the components of several candidates
are laid side by side in the fields of one wide integer. As many bits go to a field as the largest biased sum needs, so no
field ever runs into the next: one product of an anchor's component and a word serves all candidates of the word, and
shifts and masks unpack exact scores, from which the bias is taken off again.

Anchors and candidates form blocks, and each pair of blocks is one tile. A first pass over the tiles gives each anchor's
positives; a second one, with the positives' scores as bounds, the negatives below each. A tile passes on at most k rows
for an anchor and positive, whatever the number of candidates, and of these a task passes on k before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bits of a word that are used; fields wider than that go into Python's integers, so many to a word.
WORD_BITS, WIDE_FIELDS = 64, 4


def whole_numbers(x: np.ndarray, factor: float) -> np.ndarray:
    """floor(factor * x) exactly: 64-bit integers where they are small enough to be multiplied, else Python's."""
    out = np.floor(factor * x)
    if out.size == 0 or np.abs(out).max() < 1 << 28:
        return out.astype(np.int64)
    return np.array([[int(v) for v in row] for row in out], dtype=object).reshape(out.shape)


class Packed:
    """Candidates' components in the fields of wide integers, to be multiplied by components of at most `most` above `least`."""

    def __init__(self, candidates: np.ndarray, least: int, most: int):
        n, dims = candidates.shape
        self.n, self.dims, self.anchor_bias = n, dims, least
        self.bias = int(candidates.min()) if candidates.size else 0
        shifted = candidates - self.bias
        largest = dims * (most - least) * (int(shifted.max()) if shifted.size else 0)
        self.bits = max(1, int(largest).bit_length())
        self.fields = WORD_BITS // self.bits or WIDE_FIELDS
        self.kind = np.uint64 if self.bits <= WORD_BITS else object
        self.sums = candidates.sum(axis=1)
        per = -(-n // self.fields)
        full = np.zeros((per * self.fields, dims), dtype=self.kind)
        full[:n] = shifted.astype(self.kind)
        # Field f of word w holds candidate f * per + w.
        self.words = np.zeros((per, dims), dtype=self.kind)
        for f in range(self.fields):
            self.words |= full[f * per : (f + 1) * per] << self._places(f)

    def _places(self, field: int):
        return self.kind(field * self.bits) if self.kind is np.uint64 else field * self.bits

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """The inner products of all anchors and candidates."""
        products = (anchors - self.anchor_bias).astype(self.kind) @ self.words.T
        mask = (1 << self.bits) - 1
        mask = np.uint64(mask) if self.kind is np.uint64 else mask
        fields = np.concatenate([(products >> self._places(f)) & mask for f in range(self.fields)], axis=1)[:, : self.n]
        # sum (a - p)(c - q) = sum ac - q sum a - p sum c + dims p q
        p, q = self.anchor_bias, self.bias
        whole = fields.astype(np.int64 if self.kind is np.uint64 and anchors.dtype != object and self.sums.dtype != object else object)
        return whole + q * anchors.sum(axis=1)[:, None] + p * self.sums[None, :] - self.dims * p * q


def first(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest allowed scores of each row, or all; ties to the smaller column."""
    n = scores.shape[1]
    if n == 0 or not allowed.any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    low, high = int(scores.min()), int(scores.max())
    kind = np.int64 if (high - low + 1) * n < 1 << 62 else object
    key = np.where(allowed, (scores.astype(kind) - low) * n + (n - 1 - np.arange(n)), -1)
    if n > k:
        columns = np.argpartition(key, n - k, axis=1)[:, n - k :] if kind is np.int64 else np.argsort(key, axis=1)[:, n - k :]
    else:
        columns = np.broadcast_to(np.arange(n), (len(key), n))
    rows = np.repeat(np.arange(len(key)), columns.shape[1])
    columns = columns.ravel()
    fine = allowed[rows, columns]
    return rows[fine], columns[fine]


def _tiles(anchors: DataFrame, rows: DataFrame, anchor_block: int, block: int) -> DataFrame:
    """Each pair of a block of anchors (role 0) and a block of rows (role 1) together in one partition, anchors first."""
    n, m = rows.count(), anchors.count()
    blocks, anchor_blocks = -(-n // block) or 1, -(-m // anchor_block) or 1
    spread = lambda column, number: F.pmod(F.xxhash64(column), F.lit(number)).cast("int")
    every = lambda number: F.explode(F.sequence(F.lit(0), F.lit(number - 1)))
    more = [c for c in ("positives",) if c in anchors.columns]
    none = [F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in more]
    asked = anchors.select("dim", spread("vec_id", anchor_blocks).alias("ab"), every(blocks).alias("cb"), F.lit(0).alias("role"), "vec_id", F.lit(0).cast("long").alias("copy"), "label", "v", *more)
    given = rows.select("dim", every(anchor_blocks).alias("ab"), spread("copy", blocks).alias("cb"), F.lit(1).alias("role"), "vec_id", "copy", "label", "v", *none)
    both = asked.unionByName(given)
    return both.repartition("dim", "ab", "cb").sortWithinPartitions("dim", "ab", "cb", "role", "vec_id", "copy")


def _over_tiles(tiles: DataFrame, factor: float, find, schema: str, step: int = 4096) -> DataFrame:
    """find(anchors, ids, copies, labels, scores) of each tile's anchors and up to `step` of its candidates at a time, as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, block, held = None, [], None, []

        def searched():
            if block is None or not held:
                return
            ids, copies, labels, x = (np.concatenate([h[i] for h in held]) for i in range(4))
            packed = Packed(whole_numbers(x, factor), block["least"], block["most"])
            yield from find(block, ids, copies, labels, packed.scores(block["v"]))

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(4)], axis=1)
            ids, copies, labels = (batch.column(c).to_numpy() for c in (4, 5, 6))
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges[:-1], edges[1:]):
                if key != tuple(keys[a, :3]):
                    yield from searched()
                    key, parts, block, held = tuple(keys[a, :3]), [], None, []
                x = batch.column(7)[a:b].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b - a, -1)
                if keys[a, 3] == 0:
                    parts.append((ids[a:b], labels[a:b], x, batch.column(8)[a:b].to_pylist() if batch.num_columns > 8 else []))
                    continue
                if block is None and parts:
                    v = whole_numbers(np.concatenate([p[2] for p in parts]), factor)
                    block = {"ids": np.concatenate([p[0] for p in parts]), "labels": np.concatenate([p[1] for p in parts]), "v": v, "least": int(v.min()) if v.size else 0, "most": int(v.max()) if v.size else 0, "positives": [q for p in parts for q in p[3]]}
                for s in range(a, b, step):
                    e = min(b, s + step)
                    held.append((ids[s:e], copies[s:e], labels[s:e], x[s - a : e - a]))
                    if sum(len(h[0]) for h in held) >= step:
                        yield from searched()
                        held = []
        yield from searched()

    return tiles.mapInArrow(run, schema)


def _positives(k: int):
    def find(block, ids, copies, labels, scores):
        allowed = (block["labels"][:, None] == labels[None, :]) & (block["ids"][:, None] != ids[None, :])
        i, j = first(scores, allowed, k)
        yield pa.RecordBatch.from_arrays([pa.array(block["ids"][i]), pa.array(ids[j]), pa.array(copies[j]), pa.array(scores[i, j].tolist(), pa.int64())], names=["anchor_id", "positive_id", "copy", "positive_score"])

    return find


def _negatives(k: int, percent: int):
    def find(block, ids, copies, labels, scores):
        other = (block["labels"][:, None] != labels[None, :]) & (block["ids"][:, None] != ids[None, :])
        found = block["positives"]
        for place in range(max((len(p) for p in found), default=0)):
            have = np.array([len(p) > place for p in found])
            top = np.array([p[place]["positive_score"] if len(p) > place else 0 for p in found], dtype=scores.dtype)[:, None]
            allowed = other & have[:, None] & (scores <= top)
            # percent * top <= 100 * score, in Python's integers where 64 bits might not hold it.
            wide = scores if abs(int(scores.max())) < 1 << 55 and abs(int(scores.min())) < 1 << 55 else scores.astype(object)
            allowed &= (percent * top.astype(wide.dtype) <= 100 * wide).astype(bool)
            i, j = first(scores, allowed, k)
            rows = [found[a][place] for a in i]
            columns = [pa.array(block["ids"][i]), pa.array([r["n"] for r in rows], pa.int32()), pa.array([r["positive_id"] for r in rows], pa.int64()), pa.array([r["positive_score"] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids[j]), pa.array(copies[j]), pa.array(scores[i, j].tolist(), pa.int64())], names=["anchor_id", "n", "positive_id", "positive_score", "negative_id", "copy", "negative_score"])

    return find


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, percent: int = 80, factor: float = 256.0, anchor_block: int = 2048, block: int = 4096) -> DataFrame:
    """vectors(vec_id long, label int, embedding) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(factor * x), a score is the integer inner product; higher scores come first, ties by
    smaller vec_id. An anchor's positives are its first other rows of its label; a positive's negatives are the first rows
    of another label whose score is at most the positive's and at least `percent` of a hundred of it. An anchor without
    positives, and a positive without such rows, gives no row; a positive score below 0 has none, as its range is empty.

    Rows with a null vec_id, label or vector, an empty vector, or a component that is null or not finite once multiplied
    take no part. Vectors are compared with those of their own dimension. Rows that share an anchor's vec_id count as the
    anchor itself, of repeated anchor rows the smallest (label, components) counts; other repeated rows are candidates each.
    Components of any size are multiplied exactly, in wider integers where needed; a score that 64 bits do not hold raises
    an error. Other columns are left out; an empty table gives an empty result.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * factor) < F.lit(float("inf"))))
    taking_part = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(fine, F.lit(False))
    rows = vectors.where(taking_part).select(F.size("embedding").alias("dim"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("v"), is_anchor.alias("is_anchor"))
    rows = stored(rows.withColumn("copy", F.monotonically_increasing_id()), "labelled")
    anchors = rows.where("is_anchor").groupBy("vec_id").agg(F.min(F.struct("label", "dim", "v")).alias("a")).select("vec_id", "a.*")
    anchors = stored(anchors, "anchors")

    near = _over_tiles(_tiles(anchors, rows, anchor_block, block), factor, _positives(positives), "anchor_id long, positive_id long, copy long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id", "copy")
    best = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives)
    best = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("n", "positive_id", "positive_score"))).alias("positives"))
    asked = stored(anchors.join(best, "vec_id"), "positives")

    schema = "anchor_id long, n int, positive_id long, positive_score long, negative_id long, copy long, negative_score long"
    found = _over_tiles(_tiles(asked, rows, anchor_block, block), factor, _negatives(negatives, percent), schema)
    order = Window.partitionBy("anchor_id", "n").orderBy(F.col("negative_score").desc(), "negative_id", "copy")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine_embeddings(vectors: DataFrame, every: int = 100) -> DataFrame:
    """hard_negatives() of embeddings: anchors are rows whose vec_id is divisible by `every`; where it is divisible by 7, a label is the next of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % every == 0)
