"""Exact medians of groups of any size, with a bounded state.

A group of few values is sorted. A larger one is searched: a mergeable quantile sketch proposes two values around the
median, exact counts of what lies below, at, and between them tell where the median is, and the search goes on between
them until few values are left. The sketch decides how fast the search is, and never what it finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.recordings import joined_by_size, kept

#: Values that one group may sort, and cells of a round's quantiles.
FEW, CELLS = 50_000, 256


def exact_medians(values: DataFrame, keys: list[str], value: str, few: int = FEW, cells: int = CELLS) -> DataFrame:
    """keys, n, median: the middle value of each group, or the mean of the two middle ones. NULL and NaN don't count.

    values is read once for the counts and once for groups of up to `few` values. Larger groups, as a rule none, take
    two more reads a round, and a round narrows a group by about `cells` / 3. Groups without a value have no row.
    """
    v = F.col(value).cast("double")
    rows = values.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("_v"))
    sizes = kept(rows.groupBy(*keys).agg(F.count("*").alias("n")), "sizes")
    small, large = sizes.where(F.col("n") <= few), sizes.where(F.col("n") > few)
    out = joined_by_size(rows, small, keys).groupBy(*keys).agg(F.first("n").alias("n"), F.percentile("_v", 0.5).alias("median"))
    if large.isEmpty():
        return out
    none = F.lit(None).cast("double")
    low, high = F.floor((F.col("n") - 1) / 2).cast("long"), F.floor(F.col("n") / 2).cast("long")
    # Ranks r1 and r2 from 0 and their values once known; of the others, those in (lo, hi), `before` values come first.
    state = kept(large.select(*keys, "n", low.alias("r1"), high.alias("r2"), none.alias("v1"), none.alias("v2"), none.alias("lo"), none.alias("hi"), F.lit(0).cast("long").alias("before"), F.col("n").alias("inside")), "search")
    while not (wide := state.where(_open() & (F.col("inside") > few))).isEmpty():
        closer = _narrowed(rows, wide, keys, cells)
        state = kept(closer.unionByName(state.where(~_open() | (F.col("inside") <= few))), "search")
    ended = joined_by_size(rows, state.where(_open()), keys).where(_within())
    few_left = ended.groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_left"))
    found = state.join(few_left, keys, "left")
    pick = lambda v, r: F.coalesce(v, F.get("_left", (F.col(r) - F.col("before")).cast("int")))
    # The same sum as that of percentile().
    middle = F.lit(0.5) * pick("v1", "r1") + F.lit(0.5) * pick("v2", "r2")
    return out.unionByName(found.select(*keys, "n", F.when(F.col("r1") == F.col("r2"), pick("v1", "r1")).otherwise(middle).alias("median")))


def _open() -> Column:
    return F.col("v1").isNull() | F.col("v2").isNull()


def _within() -> Column:
    """Whether _v lies between lo and hi, where these are known."""
    return F.coalesce(F.col("_v") > F.col("lo"), F.lit(True)) & F.coalesce(F.col("_v") < F.col("hi"), F.lit(True))


def _narrowed(rows: DataFrame, state: DataFrame, keys: list[str], cells: int) -> DataFrame:
    """state, narrowed between two of its quantiles, or beside them if the sketch was wrong."""
    near = joined_by_size(rows, state, keys).where(_within())
    sketch = near.groupBy(*keys).agg(F.percentile_approx("_v", [i / cells for i in range(cells + 1)], 10 * cells).alias("_q"))
    rank = F.when(F.col("v1").isNull(), F.col("r1")).otherwise(F.col("r2")) - F.col("before")
    cell = F.floor(rank * cells / F.col("inside")).cast("int")
    proposed = kept(state.join(sketch, keys).withColumns({"_a": F.get("_q", F.greatest(cell - 1, F.lit(0))), "_b": F.get("_q", F.least(cell + 2, F.lit(cells)))}).drop("_q"), "proposed")
    v, a, b = F.col("_v"), F.col("_a"), F.col("_b")
    counts = joined_by_size(rows, proposed, keys).where(_within()).groupBy(*keys).agg(F.count_if(v < a).alias("_below"), F.count_if(v == a).alias("_at_a"), F.count_if((v > a) & (v < b)).alias("_between"), F.count_if((v == b) & (b > a)).alias("_at_b"))
    at = proposed.join(counts, keys)
    ends, total = [], F.lit(0)
    for part in ("_below", "_at_a", "_between", "_at_b"):
        total = total + F.col(part)
        ends.append(total)

    def seen(value: str, r: str) -> Column:
        q = F.col(r) - F.col("before")
        return F.coalesce(F.col(value), F.when((q >= ends[0]) & (q < ends[1]), a).when((q >= ends[2]) & (q < ends[3]), b))

    at = at.withColumns({"v1": seen("v1", "r1"), "v2": seen("v2", "r2")})
    q = F.when(F.col("v1").isNull(), F.col("r1")).otherwise(F.col("r2")) - F.col("before")
    first, middle = q < ends[0], q < ends[2]
    new = {
        "lo": F.when(first, F.col("lo")).when(middle, a).otherwise(b),
        "hi": F.when(first, a).when(middle, b).otherwise(F.col("hi")),
        "before": F.col("before") + F.when(first, 0).when(middle, ends[1]).otherwise(ends[3]),
        "inside": F.when(first, ends[0]).when(middle, F.col("_between")).otherwise(F.col("inside") - ends[3]),
    }
    return at.select(*keys, "n", "r1", "r2", "v1", "v2", *[x.alias(c) for c, x in new.items()])
