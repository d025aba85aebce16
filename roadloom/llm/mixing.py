"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only.

Every document gets the key -ln(u) / quality weight, where u is a hash of its id; the documents of a source in the order
of their keys are a weighted random permutation. A source whose target exceeds its size is taken in complete epochs first;
the rest of the target is filled with the documents that come first. No source is sorted whole: keys are dealt into
buckets, sizes are summed per bucket, and only the bucket in which the target falls is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, stored

#: Sources' figures are broadcast up to so many sources.
MOST_BROADCAST = 20_000
#: No source is taken more often than this.
MOST_EPOCHS = 3


def word_count(text: str | Column) -> Column:
    """Words of a text, runs without ASCII white space; null: 0."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(key: str | Column) -> Column:
    """A number strictly between 0 and 1 from the first 13 hex digits of the MD5 of a key's text."""
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame) -> DataFrame:
    """sizes(source, source_size long, rows long), one row per source, adds source_weight and target.

    Sources by code point, null last, weigh 1, 2, 3, repeating. Targets share the sum of all sizes by weight; what exceeds
    MOST_EPOCHS times a source's size is shared again among the others until no target is above its cap. With the sources
    in order of cap / weight, the capped ones come first, so running sums give the fixed point directly.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    named = sizes.withColumn("source_weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("_cap", F.col("source_size") * MOST_EPOCHS)
    by_ratio = Window.orderBy(F.col("_cap") / F.col("source_weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = named.select(
        "*",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0))).alias("_left"),
        (F.sum("source_weight").over(whole) - F.coalesce(F.sum("source_weight").over(before), F.lit(0))).alias("_weights"),
    )
    # A source is capped if a fair share of what is left would exceed its cap, given that all before it are capped.
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    fits = exact("_left") * exact("source_weight") <= exact("_cap") * exact("_weights")
    first = F.min(F.when(fits, F.struct(F.col("_cap") / F.col("source_weight"), F.col("source").isNull(), F.col("source").cast("binary"), "_left", "_weights"))).over(whole)
    level = run.withColumn("_fits", fits).withColumn("_first", first)
    share = F.col("_first._left").cast("double") * F.col("source_weight") / F.col("_first._weights")
    after = F.struct(F.col("_cap") / F.col("source_weight"), F.col("source").isNull(), F.col("source").cast("binary")) >= F.struct(F.col("_first.col1"), F.col("_first.col2"), F.col("_first.col3"))
    return level.withColumn("target", F.when(F.col("_first").isNotNull() & after, share).otherwise(F.col("_cap").cast("double"))).drop("_cap", "_left", "_weights", "_first", "_fits")


def mix(docs: DataFrame, weight: str = "weight", rows_per_bucket: int = 2_000) -> DataFrame:
    """docs(doc_id, source, size long, weight double > 0) -> all columns and source_size, target, taken.

    taken is size times the number of copies in the mix. Targets follow source_targets(); a document in the last, partial
    epoch is chosen if its middle lies within the target, so a source misses its target by half a document at most. Null
    sources are one source. Null or non-positive weights count as 1. Documents of size 0 take 0. Repeated rows are rows of
    their own. Ties of keys fall to the smaller doc_id, then to the smaller size. Columns of docs of any other names stay as
    they are; those named source_size, target or taken are replaced. An empty table gives an empty result.
    """
    w = F.when(F.col(weight) > 0, F.col(weight)).otherwise(1.0)
    kept = [c for c in docs.columns if c not in ("source_size", "target", "taken")]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_doc"), "doc_id", "source", "size", (-F.log(unit_hash("doc_id")) / w).alias("_key"))
    totals = source_targets(docs.select("source", "size").groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows")))
    spec = totals.select(
        F.col("source").alias("_source"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("_epochs"),
        F.ceil(F.col("_rows") / rows_per_bucket).cast("long").alias("_buckets"),
    ).withColumn("_rest", F.col("target") - (F.col("_epochs") * F.col("source_size")).cast("double"))
    bucket = F.floor((1 - F.exp(-F.col("_key"))) * F.col("_buckets")).cast("long")
    # One row per source: broadcast up to a checked number of them, else joined by sort and merge.
    few = totals.count() <= MOST_BROADCAST
    spec = F.broadcast(spec) if few else spec
    dealt = keyed.join(spec, keyed["source"].eqNullSafe(spec["_source"])).withColumn("_bucket", bucket)
    sums = dealt.groupBy("_source", "_bucket").agg(F.sum("size").alias("_sum"), F.first("_rest").alias("_rest"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = sums.withColumn("_before", before).where((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_sum") >= F.col("_rest")))
    cut = cut.groupBy("_source").agg(F.min(F.struct("_bucket", "_before")).alias("_c")).select(F.col("_source").alias("_cut_source"), F.col("_c._bucket").alias("_cut"), F.col("_c._before").alias("_before"))
    cut = F.broadcast(cut) if few else cut
    placed = dealt.join(cut, dealt["_source"].eqNullSafe(cut["_cut_source"]), "left")
    inside = F.coalesce(F.col("_bucket") == F.col("_cut"), F.lit(False))
    # Only the rows of a source's cut bucket are sorted, about rows_per_bucket of them.
    order = Window.partitionBy("_source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = F.col("_before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    at_cut = placed.where(inside).withColumn("_in", 2 * run + F.col("size") <= 2 * F.col("_rest"))
    # Without a cut bucket the rest is 0, or it is all of the source.
    away = placed.where(~inside).withColumn("_in", F.coalesce(F.col("_bucket") < F.col("_cut"), F.col("_rest") >= F.col("source_size")))
    taken = F.when(F.col("size") > 0, F.col("size") * (F.col("_epochs") + F.col("_in").cast("long"))).otherwise(0)
    return at_cut.unionByName(away).withColumn("taken", taken).select("_doc.*", "source_size", "target", "taken")


def quality_weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, ...) with weight: 2 where labels mark the document as good (quality 1), 0.5 where as bad (0), else 1."""
    doc, quality = fresh(docs, "labelled", "quality")
    by_doc = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(doc)).agg(F.max("quality").alias(quality))
    weight = F.when(F.col(quality) == 1, 2.0).when(F.col(quality) == 0, 0.5).otherwise(1.0)
    return docs.join(by_doc, docs["doc_id"] == by_doc[doc], "left").withColumn("weight", weight).drop(doc, quality)


def mix_documents(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    sized = stored(quality_weights(docs.select("doc_id", "source", word_count("text").alias("size")), labels.select("doc_id", "quality")), "sized")
    return mix(sized, **params).select("doc_id", "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, its columns unchanged, whatever their names.

    Rows of null or empty text are never taken, as they have no words. Rows equal in all columns are taken as often as they
    are together; null doc_ids and sources are ids and sources like others. An empty table gives an empty result.
    """
    row, times, same = fresh(docs, "row", "times", "same")
    keyed = docs.withColumn(row, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    slim = keyed.select("doc_id", "source", F.col(row).alias("row"), word_count("text").alias("size"))
    # Repeated rows are told apart by nothing, so they are counted and their copies summed.
    sized = stored(quality_weights(slim, labels.select("doc_id", "quality")), "sized")
    copies = mix(sized, **params).groupBy("row", "doc_id").agg(F.sum(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0)).cast("int").alias(times), F.count("*").cast("int").alias(same))
    id_, number = fresh(keyed, "taken_id", "taken_row")
    copies = copies.where(F.col(times) > 0).select(F.col("row").alias(number), F.col("doc_id").alias(id_), times, same)
    joined = keyed.join(copies, (F.col(row) == F.col(number)) & keyed["doc_id"].eqNullSafe(F.col(id_)))
    once = joined.where(F.col(same) == 1).unionByName(joined.where(F.col(same) > 1).dropDuplicates([row, id_]))
    (copy,) = fresh(once, "copy")
    return once.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])
