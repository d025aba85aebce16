"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at up to two differing bits.

Fingerprints within two bits are found by equality joins on deletion variants. A fingerprint is cut into two segments
(16 and 48 bits); of two differing bits, one segment has at most one. Three kinds of keys cover all splits of the bits:
the short segment as it is (all differing bits are in the long one, so one of its three parts is equal too), the long
segment as it is, and the short segment with one bit deleted (a wildcard) next to either half of the long one. Every pair
that shares a key is verified. Equal fingerprints are one row before the join, so copies are never paired.

Texts of similarity 0.8 differ in about 15 of 100 bits, which no cut of 64 bits finds, so drop_near_duplicates() goes on
with an exact way for what the variants don't connect.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import extended, fresh, matching, releasing, stored, without
from .components import connected_components
from .shingles import TEXTS_PER_BATCH, common_shingles, majority, possible_pairs, shingle_hashes, similar_components, similar_pairs, with_sets

_LONG, _PART, _HALF = (1 << 48) - 1, (1 << 16) - 1, (1 << 24) - 1


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The signed 64-bit fingerprint of one text; no words: 0."""
    return majority(np.array(shingle_hashes(text, width, seed), dtype=np.uint64))


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "_fp", width: int = 3) -> DataFrame:
    """docs with the fingerprint of whole texts as a long; one pass, no shuffle. Null text counts as empty."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py(), width) for t in batch.column(at)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, fps], names=[*batch.schema.names, out])

    return docs.mapInArrow(releasing(run), extended(docs, **{out: "long"}))


def variant_keys(fp: str = "fp"):
    """Array of the 36 keys of a fingerprint; two fingerprints share one if they differ in at most two bits."""
    x = F.col(fp)
    short, long = F.shiftrightunsigned(x, 48), x.bitwiseAND(F.lit(_LONG))
    key = lambda kind, value: value.bitwiseOR(F.lit(kind << 56))
    parts = [key(p, F.shiftleft(short, 16).bitwiseOR(F.shiftrightunsigned(long, 16 * p).bitwiseAND(F.lit(_PART)))) for p in range(3)]
    whole = [key(3, long)]
    wild = [key(4 + 2 * j + h, F.shiftleft(short.bitwiseAND(F.lit(~(1 << j) & _PART)), 24).bitwiseOR(F.shiftrightunsigned(long, 24 * h).bitwiseAND(F.lit(_HALF)))) for j in range(16) for h in range(2)]
    return F.array(*parts, *whole, *wild)


def linked_fingerprints(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """distinct(fp) -> pairs (a, b), a < b, of fingerprints that differ in 1 to max_bits bits; max_bits is 2 at most."""
    if not 0 <= max_bits <= 2:
        raise ValueError("deletion variants of two segments find at most two differing bits")
    keyed = distinct.select(F.col("fp"), F.explode(variant_keys("fp")).alias("key"))
    # Spark sizes keyed as if distinct were not exploded, and would broadcast its 36 rows a fingerprint.
    left, right = keyed.select("key", F.col("fp").alias("a")), keyed.select("key", F.col("fp").alias("b")).hint("merge")
    return left.join(right, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b").distinct()


def fingerprint_components(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """fps(doc_id, fp) -> one row per distinct fp: fp, label (one fp of its component), component_id (the component's smallest doc_id).

    A component whose rows all have a null doc_id has a null component_id.
    """
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    labels = connected_components(linked_fingerprints(classes.select("fp"), max_bits))
    named = classes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("label"))
    return named.join(named.groupBy("label").agg(F.min("first").alias("component_id")), "label").select("fp", "label", "component_id")


def simhash_documents(docs: DataFrame, width: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document.

    Words are maximal runs without ASCII white space, A-Z lower-cased; null text counts as empty and has fingerprint zero,
    linked like any other. An empty table gives an empty result.
    """
    fps = stored(with_fingerprint(docs.select("doc_id", "text"), out="fp", width=width).drop("text"), "fingerprints")
    return fps.join(fingerprint_components(fps, max_bits), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def led_fingerprints(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """distinct(fp) -> pairs (a, b) of fingerprints within max_bits, each with the smallest fingerprint of a bucket it is in.

    A crowded bucket costs a comparison per row, not per pair; pairs that it leaves out are for the caller to find.
    """
    keyed = distinct.select(F.col("fp").alias("a"), F.explode(variant_keys("fp")).alias("key"))
    led = keyed.select("a", F.min("a").over(Window.partitionBy("key")).alias("b"))
    return led.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).distinct()


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, max_bits: int = 2) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id, of repeated ids the first by its columns' hash.

    Groups are connected through links between texts whose sets of distinct word shingles have at least the given Jaccard
    similarity; all such pairs are found and each link is verified by whole texts. Equal texts become one by their SHA-256
    first, texts with the same set are one class, known by a 64-bit hash. Candidates come from the classes' SimHash
    fingerprints by deletion variants first, which connect groups of copies cheaply, and then, as pairs of similarity 0.8
    differ in about ten of 64 bits, from the exact join of shingles.similar_components() for all that isn't connected yet.
    Texts without words are alike. All columns are kept as they are. Rows with a null doc_id that are alone in their group
    stay; of rows equal in all columns one stays. An empty table gives an empty result.
    """
    key, row, digest = fresh(docs, "key", "row", "digest")
    known = docs.withColumns({key: F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)), row: F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])})
    ids = stored(known.select(F.col(key).alias("key"), F.col(row).alias("row"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")), "ids")
    firsts = ids.groupBy("digest").agg(F.min(F.struct("key", "row")).alias("best")).select("best.*")
    copies = stored(ids.select("key", "row").distinct().join(firsts, ["key", "row"], "left_anti"), "copies")
    repeated = stored(ids.groupBy("key", "row").count().where("count > 1").select("key", "row"), "repeated")
    rows = known.select(F.col(key).alias("key"), F.col(row).alias("row"), "text")
    texts = without(rows, copies, ["key", "row"])
    sets = stored(with_sets(texts, common_shingles(texts, width), similarity, width), "sets", TEXTS_PER_BATCH)
    classes = stored(sets.where("prefix IS NOT NULL").drop("prefix").dropDuplicates(["node"]), "classes")
    verified = lambda pairs: similar_pairs(pairs, classes, rows, similarity, width)
    prints = stored(classes.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    led = led_fingerprints(prints.select("fp"), max_bits)
    name = lambda x: prints.select(F.col("fp").alias(x), F.col("first").alias(f"node_{x}"))
    pairs = led.join(name("a"), "a").join(name("b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    alike = classes.join(prints, "fp").where("node != first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    pairs = stored(possible_pairs(pairs.unionByName(alike), classes, similarity), "variants")
    links = stored(verified(pairs), "variant-links", TEXTS_PER_BATCH)
    labels = similar_components(classes, sets.where("prefix IS NOT NULL"), verified, similarity, links).withColumnRenamed("node", "n")
    best = sets.groupBy("node").agg(F.min(F.struct("key", "row")).alias("best"))
    best = best.join(labels, F.col("node") == F.col("n"), "left").groupBy(F.coalesce("component", "node").alias("label")).agg(F.min("best").alias("best"))
    near = sets.select("key", "row").distinct().join(best.select("best.*"), ["key", "row"], "left_anti")
    gone = stored(copies.unionByName(near), "gone").select(F.col("key").alias(key), F.col("row").alias(row))
    kept = without(known, gone, [key, row])
    if not repeated.isEmpty():
        repeated = repeated.select(F.col("key").alias(key), F.col("row").alias(row))
        kept = without(kept, repeated, [key, row]).unionByName(matching(kept, repeated, [key, row]).dropDuplicates([key, row]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
