"""Sums over what comes earlier, without a task that sees everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lograft.sources.shared import kept


def _earlier(*by: str) -> WindowSpec:
    return Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)


def counts_before(counts: DataFrame, source: str, place: str, width: int = 4096) -> DataFrame:
    """``counts`` (source, place, _n, ...) with ``_before``: the sum of ``_n`` at earlier places.

    Places are summed in groups of ``width``, and the groups before added, so that a source with
    millions of places is no single task.
    """
    grouped = counts.withColumn("_group", F.floor(F.col(place) / width))
    groups = grouped.groupBy(source, "_group").agg(F.sum("_n").alias("_all"))
    earlier = _earlier(source).orderBy("_group")
    groups = groups.select(
        source, "_group", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_base")
    )
    within = _earlier(source, "_group").orderBy(place)
    own = grouped.withColumn("_own", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    return own.join(groups, [source, "_group"]).select(
        *counts.columns, (F.col("_base") + F.col("_own")).alias("_before")
    )


def totals_before(counts: DataFrame, ranges: int, *order: Column | str) -> DataFrame:
    """``counts`` (..., _n) with ``_before``: the sum of ``_n`` over all rows earlier in ``order``.

    The rows are dealt out by ranges of ``order``, which is unique. One sum per range reaches the
    driver.
    """
    dealt = kept(
        counts.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    )
    base, so_far = [], 0
    for number, n in sorted(dealt.groupBy("_range").agg(F.sum("_n")).collect()):
        base.append((number, so_far))
        so_far += n
    starts = counts.sparkSession.createDataFrame(base, "_range int, _base bigint")
    within = _earlier("_range").orderBy(*order)
    own = dealt.withColumn("_own", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    return own.join(F.broadcast(starts), "_range").select(
        *counts.columns, (F.col("_base") + F.col("_own")).alias("_before")
    )
