"""Sets of word shingles: candidates by an exact join over the first shingles of a common order, verified by whole texts.

Two sets of n shingles with a Jaccard similarity of t share k of their first n - ceil(t n) + k in any order of all
shingles, so a join over these misses no pair. k grows with the set (kin()), so that long texts that share a passage are no
candidates. Candidates are dropped only by bounds that no similar pair breaks (how many shingles of these are shared,
places in the order, parities of hashes); the rest are verified by their whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import extended, matching, releasing, sample_order, stored
from .components import connected_components

#: 64-bit words of the parities of a set's hashes, and of their short form.
PARITY_WORDS, SHORT_WORDS = 16, 4
#: Texts that are turned into sets at a time, and sets that a task remembers to tell repeats.
SLICE, REMEMBERED = 256, 1 << 16
#: Rows of whole texts that a Python worker gets at once.
TEXTS_PER_BATCH = 500


def shingle_hashes(text: str | None, width: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of each shingle of words, repeats included; fewer words than width are one shingle, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    if len(words) <= width:
        return [xxh64_intdigest(b" ".join(words), seed)]
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[: -width])).tolist()
    return [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]


def majority(hashes: np.ndarray) -> int:
    """The signed 64-bit number whose bits are 1 where over half of the hashes have a 1; no hashes: 0."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        h = hashes[i : i + (1 << 14)].astype("<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def distinct_shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes of the distinct shingles of a text, sorted."""
    return np.unique(np.array(shingle_hashes(text, width), dtype=np.uint64))


def kin(size):
    """How many shingles of their prefixes similar sets share at least, by the smaller size; a number or a column."""
    return 1 + size // 25 if isinstance(size, int) else (1 + F.floor(size / 25)).cast("int")


def common_shingles(docs: DataFrame, width: int, share: float = 0.04, least: int = 2, most: int = 1_000_000) -> np.ndarray:
    """docs(key, row, text) -> shingles of least or more texts of a sample, sorted; they go last in the order of shingles.

    Any order finds all pairs, this one with fewer candidates: the sample sets the cost only. As it is a share of the texts,
    shingles of some hundred texts are found at every size; the commonest `most` of them are sent to the tasks, 8 bytes each.
    """
    sample = docs.where(sample_order("key", "row") < share).select("text")

    def run(batches):
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(distinct_shingles(text.as_py(), width).astype(np.int64))], names=["h"])

    counts = sample.mapInArrow(releasing(run), "h long").groupBy("h").count().where(F.col("count") >= least)
    found = stored(counts, "common", TEXTS_PER_BATCH).orderBy(F.desc("count"), "h").limit(most).select("h").toArrow()
    return np.sort(found.column(0).to_numpy().astype(np.int64).view(np.uint64))


def with_sets(docs: DataFrame, common: np.ndarray, similarity: float, width: int, text: str = "text") -> DataFrame:
    """docs without the text and with node, fp, size, prefix and parity of its set of shingles; one pass, no shuffle.

    node is a hash of the set, fp its SimHash, size its number n of shingles and prefix the first
    n - ceil(similarity * n) + kin(n) in the order of shingles. parity has a bit for each class of hashes, set if the class holds an odd number: two sets
    differ in as many shingles as their parities at least. A set that the task remembers from before has no prefix and no
    parity (null), so that many texts of one set, which spaces and case tell apart, cost what one costs.
    """
    at, shared = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(common)

    def prefix(h: np.ndarray) -> np.ndarray:
        n = len(h)
        at = np.searchsorted(shared.value, h)
        late = shared.value[np.minimum(at, len(shared.value) - 1)] == h if len(shared.value) else np.zeros(n, dtype=bool)
        return np.concatenate((h[~late], h[late]))[: n - math.ceil(similarity * n - 1e-9) + kin(n) if n else 0]

    def parity(h: np.ndarray) -> np.ndarray:
        odd = np.bincount((h % np.uint64(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(REMEMBERED, dtype=np.uint64)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                nodes, fps, sizes, first, bits = [], [], [], [], []
                for t in part.column(at):
                    h = distinct_shingles(t.as_py(), width)
                    node = np.uint64(xxh64_intdigest(h.tobytes()))
                    place = int(node % np.uint64(REMEMBERED))
                    repeat, met[place] = met[place] == node, node
                    nodes.append(node)
                    fps.append(majority(h))
                    sizes.append(len(h))
                    first.append(None if repeat else prefix(h).view(np.int64))
                    bits.append(None if repeat else parity(h))
                more = [pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(first, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))]
                rest = part.drop_columns([text])
                yield pa.RecordBatch.from_arrays([*rest.columns, *more], names=[*rest.schema.names, "node", "fp", "size", "prefix", "parity"])

    return docs.mapInArrow(releasing(run), extended(docs.drop(text), node="long", fp="long", size="int", prefix="array<long>", parity="array<long>"))


def possible_pairs(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """pairs(a, b) of nodes of classes(node, size, parity) -> those that the parities allow, all similar ones among them."""
    side = lambda n, out: classes.select(F.col("node").alias(n), F.struct("size", "parity").alias(out))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where(_parities_allow(similarity, "x", "y")).select("a", "b")


def similar_pairs(pairs: DataFrame, classes: DataFrame, docs: DataFrame, similarity: float, width: int) -> DataFrame:
    """pairs(a, b) of nodes -> those whose sets have the Jaccard similarity, by whole texts.

    classes(node, key, row) names a document of each node; docs(key, row, text) are read twice, and only texts of a pair
    are shuffled.
    """
    ids = lambda n: classes.select(F.col("node").alias(n), "key", "row")
    left = matching(docs, pairs.join(ids("a"), "a"), ["key", "row"], extra=["a", "b"]).select("a", "b", F.col("text").alias("text_a"))
    right = matching(docs, pairs.select("b").distinct().join(ids("b"), "b"), ["key", "row"], extra=["b"]).select("b", F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, y = None, None
        for batch in batches:
            keep = []
            for b, text_a, text_b in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if b != last:
                    last, y = b, distinct_shingles(text_b.as_py(), width)
                x = distinct_shingles(text_a.as_py(), width)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return left.join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(releasing(run), "a long, b long")


def _may_be_similar(similarity: float, a: str = "a", b: str = "b"):
    """Whether two sets can have the similarity if they share a shingle at these places of theirs."""
    size, other, at, there = (F.col(f"{x}.{c}") for c in ("size", "at") for x in (a, b))
    need = similarity / (1 + similarity) * (size + other) - 1e-6
    return F.least(at, there) + F.least(size - at, other - there) >= need


def _most_differing(similarity: float, a: str = "a", b: str = "b"):
    """How many shingles, and so how many parities, two sets of the similarity can differ in."""
    return (1 - similarity) / (1 + similarity) * (F.col(f"{a}.size") + F.col(f"{b}.size")) + 1e-6


def _parities_allow(similarity: float, a: str = "a", b: str = "b"):
    """Whether the parities of two sets of the similarity can differ in so many bits."""
    differ = sum((F.bit_count(F.col(f"{a}.parity")[i].bitwiseXOR(F.col(f"{b}.parity")[i])) for i in range(PARITY_WORDS)), F.lit(0))
    return differ <= _most_differing(similarity, a, b)


def _labelled(rows: DataFrame, links: DataFrame | None, name: str) -> DataFrame:
    """rows(node, ...) with component, their own node where no link reaches them."""
    if links is None:
        return rows.withColumn("component", F.col("node"))
    labels = stored(connected_components(links), name).select(F.col("node").alias("n"), F.col("component"))
    return rows.join(labels, F.col("node") == F.col("n"), "left").drop("n").withColumn("component", F.coalesce("component", "node"))


def similar_components(
    classes: DataFrame, prefixes: DataFrame, verified: Callable[[DataFrame], DataFrame], similarity: float, links: DataFrame | None = None, block: int = 256, rounds: int = 3
) -> DataFrame:
    """classes(node, size, parity), a row per set, prefixes(node, size, prefix) -> (node, component) of the graph of all similar pairs.

    verified turns pairs(a, b) into the similar ones among them; links are similar pairs known already. A set may have
    several prefixes, all the same. Rows that share a
    shingle of their prefixes are a bucket. First each row is compared with one leader of its buckets and linked if
    similar, a few times with other leaders while buckets are crowded, so that groups of copies become one component
    without being paired off. Then all pairs of a bucket that are not yet in one component are compared, crowded buckets
    dealt by blocks: pairs that are skipped are connected already, so the components are those of all pairs.
    """
    same = Window.partitionBy("shingle")
    mixed = F.min("component").over(same) != F.max("component").over(same)
    left = _labelled(prefixes.select("node", "size", "prefix"), links, "labels").select("node", "component", "size", F.posexplode("prefix").alias("at", "shingle"))
    left = stored(left.withColumn("mixed", mixed).where("mixed").drop("mixed").dropDuplicates(["shingle", "node"]), "buckets")
    before = None
    for r in range(rounds):
        n = F.col("count")
        pairs_left, rows = left.groupBy("shingle").count().agg(F.sum(n * (n - 1) / 2), F.sum(n)).first()
        if (pairs_left or 0) <= 2 * (rows or 0) or before and rows > before * 2 / 3:
            break  # few pairs are left, or buckets of strangers, which leaders don't connect
        before = rows
        # A text whose copies were edited has few shingles of its own, and so meets them at the first place: it leads first.
        order = F.struct((F.col("at") if r == 0 else F.lit(0)).alias("place"), F.xxhash64("component", F.lit(r)), F.xxhash64("node", F.lit(r)), "node", "size", "at", "component")
        led = left.select("node", "component", F.struct("size", "at").alias("a"), F.min(order).over(same).alias("b"))
        led = led.where((F.col("component") != F.col("b.component")) & _may_be_similar(similarity)).groupBy("node", F.col("b.node").alias("leader")).agg(F.count("*").alias("n"))
        pairs = led.groupBy("node").agg(F.max(F.struct("n", "leader")).alias("o")).select(F.col("node").alias("a"), F.col("o.leader").alias("b"))
        new = stored(verified(stored(possible_pairs(pairs, classes, similarity), f"pairs-{r}")), f"links-{r}", TEXTS_PER_BATCH)
        links = new if links is None else links.unionByName(new)
        left = stored(_labelled(left.drop("component"), links, f"labels-{r}").withColumn("mixed", mixed).where("mixed").drop("mixed"), f"buckets-{r}")
    parts = left.groupBy("shingle").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    # Parities of fewer classes, as they go to every bucket of a set.
    short = [F.reduce(F.transform(F.sequence(F.lit(i), F.lit(PARITY_WORDS - 1), F.lit(SHORT_WORDS)), lambda k: F.col("parity")[k]), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y)).alias(f"p{i}") for i in range(SHORT_WORDS)]
    left = left.join(classes.select("node", *short), "node")
    dealt = left.join(parts, "shingle").select("shingle", F.struct("node", "size", "at", "component", *[f"p{i}" for i in range(SHORT_WORDS)]).alias("x"), "parts", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"))
    one = dealt.select("shingle", F.col("x").alias("a"), F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"))
    two = dealt.select("shingle", F.col("x").alias("b"), F.col("part").alias("j"), F.explode(F.sequence(F.lit(0), "part")).alias("i"))
    apart = (F.col("a.component") != F.col("b.component")) & ((F.col("i") < F.col("j")) | (F.col("a.node") < F.col("b.node")))
    differ = sum((F.bit_count(F.col(f"a.p{i}").bitwiseXOR(F.col(f"b.p{i}"))) for i in range(SHORT_WORDS)), F.lit(0))
    met = one.join(two, ["shingle", "i", "j"]).where(apart & _may_be_similar(similarity) & (differ <= _most_differing(similarity)))
    pairs = met.groupBy(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).agg(F.count("*").alias("n"), F.min(F.least("a.size", "b.size")).alias("size"))
    pairs = stored(pairs.where(F.col("n") >= kin(F.col("size"))).select("a", "b"), "shared")
    pairs = possible_pairs(pairs, classes, similarity)
    new = stored(verified(stored(pairs, "pairs")), "links", TEXTS_PER_BATCH)
    return connected_components(new if links is None else links.unionByName(new))
