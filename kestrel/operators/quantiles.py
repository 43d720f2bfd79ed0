"""Exact grouped quantiles (linear interpolation) for groups of any size.

Spark's ``percentile`` is exact but keeps every distinct value of a group in one
aggregation buffer; when one group holds a third of all rows that is an unbounded buffer
in one task. This operator finds order statistics by histogram narrowing, the same way at
every size:

* a target is a rank inside a closed value range of its group, at first the whole group;
* a pass counts the values of every open range in ``buckets`` equal parts, one distributed
  hash aggregation with map-side combine: targets that share a range share its histogram,
  and as ranges are disjoint or equal no row is counted twice for a range;
* the bucket index is monotone in the value and the range's two ends fall into different
  buckets, so the bucket that holds a rank is a strictly smaller range; passes go on until
  every range is a single value.

The state has one row per group and rank. It is broadcast behind a check of its size and
written to the shared checkpoint folder after every pass, which also cuts the lineage.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.config import checkpoint_dir

BROADCAST_ROWS = 100_000


def _targets(stats: DataFrame, probs: list[float]) -> DataFrame:
    """One row per (group, p, which) with its rank ``k`` counted from the start of the range."""
    rows = []
    for p in probs:
        h = (F.col("n") - 1) * F.lit(float(p))
        k0 = F.floor(h)
        for which, k in ((0, k0), (1, F.least(k0 + 1, F.col("n") - 1))):
            rows.append(F.struct(F.lit(float(p)).alias("p"), F.lit(which).alias("which"), k.alias("k"),
                                 (h - k0).alias("frac")))
    return stats.withColumn("t", F.explode(F.array(*rows))).select(*stats.columns, "t.*").drop("n")


def _narrow(data: DataFrame, state: DataFrame, groups: list[str], buckets: int, small: bool) -> DataFrame:
    """One pass: every open target's range shrinks to the bucket that holds its rank."""
    part = [*groups, "lo", "hi"]
    ranges = state.filter("lo < hi").select(*part).distinct()
    width = F.col("hi") - F.col("lo")
    bucket = F.least(F.floor((F.col("v") - F.col("lo")) / width * buckets), F.lit(buckets - 1))
    hist = data.join(F.broadcast(ranges) if small else ranges, groups) \
        .filter(F.col("v").between(F.col("lo"), F.col("hi"))) \
        .groupBy(*part, bucket.alias("b")) \
        .agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo2"), F.max("v").alias("hi2"))
    before = Window.partitionBy(*part).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
    held = (F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("c"))
    moved = state.filter("lo < hi").join(hist, part).filter(held).select(
        *groups, F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), "p", "which",
        (F.col("k") - F.col("before")).alias("k"), "frac")
    return state.filter("lo = hi").select(*moved.columns).unionByName(moved)


def exact_quantiles(df: DataFrame, groups: list[str], value: str, probs: list[float],
                    buckets: int = 1 << 15) -> DataFrame:
    """``groups + [p, quantile]``: ``quantile_cont`` of the finite values of ``value`` per group."""
    if buckets < 2:
        raise ValueError("a range needs at least two buckets to shrink")
    checkpoint_dir(df.sparkSession)
    # Every pass reads the input: keep it (memory, spilling to disk) for the duration; a
    # lost executor recomputes its blocks from lineage.
    data = df.select(*groups, F.col(value).alias("v")).filter(F.abs("v") < float("inf")) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    stats = data.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = _targets(stats, probs).checkpoint()
    small = state.count() <= BROADCAST_ROWS
    while not state.filter("lo < hi").isEmpty():
        state = _narrow(data, state, groups, buckets, small).checkpoint()
    data.unpersist()
    x0, x1 = (F.max(F.when(F.col("which") == w, F.col("lo"))) for w in (0, 1))
    out = state.groupBy(*groups, "p").agg(x0.alias("x0"), x1.alias("x1"), F.max("frac").alias("frac"))
    return out.select(*groups, "p", (F.col("x0") + F.col("frac") * (F.col("x1") - F.col("x0"))).alias("quantile"))
