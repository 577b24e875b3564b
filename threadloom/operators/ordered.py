"""Ordered work over keys of any size.

A plain ``Window.partitionBy(chat)`` sorts a whole chat in one task.  Here rows are
range-partitioned by (key, order) instead, so a chat that holds a third of the archive is
spread over many segments; what crosses a segment border is a small summary per
(key, segment), of which a key has at most as many as there are partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

SEG = "_seg"


def segmented(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with its range segment in ``_seg``; ``keys + order`` must be unique.

    Without ``parts`` the session's partition count is the upper limit and adjacent small
    ranges are joined at run time, which keeps segments in order.
    """
    return cut(ranged(df, [*keys, *order], parts).withColumn(SEG, F.spark_partition_id()))


def ranged(df: DataFrame, by: list[str], parts: int | None = None) -> DataFrame:
    return df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)


def running_sum(seg: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Inclusive running sum of ``value`` per key over all its segments."""
    totals = seg.groupBy(*keys, SEG).agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, SEG, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, SEG).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = seg.withColumn(name, F.sum(value).over(inside))
    return local.join(offsets, [*keys, SEG]).withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "_n", parts: int | None = None) -> DataFrame:
    """Exact row number per key, segment column kept."""
    return running_sum(segmented(df, keys, order, parts), keys, order, F.lit(1), name)


def with_halo(numbered_df: DataFrame, keys: list[str], size: int, name: str = "_n") -> DataFrame:
    """Adds to every segment the ``size`` rows of its key just before it, flagged ``_halo``."""
    rows = numbered_df.withColumn("_halo", F.lit(False))
    starts = numbered_df.groupBy(*keys, SEG).agg(F.min(name).alias("_lo")).filter(F.col("_lo") > 1)
    wanted = starts.select(
        *keys, SEG, F.explode(F.sequence(F.greatest(F.col("_lo") - size, F.lit(1)), F.col("_lo") - 1)).alias(name)
    )
    halo = numbered_df.drop(SEG).join(wanted, [*keys, name]).withColumn("_halo", F.lit(True))
    return rows.unionByName(halo)
