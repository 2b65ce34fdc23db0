"""Exact median without gathering the values in one task.

Spark's exact ``percentile`` merges one buffer holding every distinct value
into a single final task. Here the values become a histogram ((group, value)
-> count, map-side combined, so a value held by a third of the rows costs one
row per map task). Values fall into logarithmic bins, ``BINS`` to a doubling;
the counts per bin tell which bins hold the two middle ranks, and only the
values of those bins are sorted. The bin of a value is a function of the value
alone, so the result does not depend on partitions, on reuse of an exchange or
on a task running twice.

Bounds: a group has at most ``2 * BINS`` bins per doubling of the largest
amount (1.7 million for 18-digit money), and a bin near amount ``x`` holds at
most ``x * 100 * ln(2) / BINS`` values of two decimals (42,000 for ten million).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VALUE_TYPE = "decimal(38,2)"
BINS = 16384


def value_histogram(df: DataFrame, group: str, value: str) -> DataFrame:
    """Rows ``(g, v, n)``: how many times each non-null value occurs per group."""
    v = df.select(F.col(group).alias("g"), F.col(value).cast(VALUE_TYPE).alias("v")).filter(F.col("v").isNotNull())
    return v.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))


def value_bin(v: Column) -> Column:
    """Bin of a value; a larger value never has a smaller bin."""
    x = v.cast("double")
    return (F.signum(x) * F.floor(F.log2(F.abs(x) + 1.0) * BINS)).cast("int")


def value_bins(hist: DataFrame) -> DataFrame:
    """Rows ``(g, bin)`` with the count ``n``, ``total``, ``min`` and ``max`` of the values in the bin."""
    return hist.groupBy("g", value_bin(F.col("v")).alias("bin")).agg(
        F.sum("n").alias("n"), F.sum(F.col("v") * F.col("n")).alias("total"),
        F.min("v").alias("min"), F.max("v").alias("max"))


def median_from_histogram(hist: DataFrame, bins: DataFrame | None = None) -> DataFrame:
    """Rows ``(g, median)`` from a ``value_histogram`` (exact; the mean of the
    two middle values for an even count), for any number of groups. ``bins``
    are its ``value_bins``, where the caller has them."""
    bins = value_bins(hist) if bins is None else bins
    whole = Window.partitionBy("g")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (bins.select("g", "bin", F.col("n").alias("held"))
              .withColumn("before", F.coalesce(F.sum("held").over(upto), F.lit(0)))
              .withColumn("total", F.sum("held").over(whole))
              .withColumn("lo", F.expr("(total - 1) div 2"))
              .withColumn("hi", F.expr("total div 2")))
    inside = lambda r: (F.col(r) >= F.col("before")) & (F.col(r) < F.col("before") + F.col("held"))
    targets = ranked.filter(inside("lo") | inside("hi")).select("g", "bin", "before", "lo", "hi")

    # at most two bins of a group survive the join
    cand = hist.withColumn("bin", value_bin(F.col("v"))).join(targets, ["g", "bin"])
    run = Window.partitionBy("g", "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    cand = cand.withColumn("cum", F.col("before") + F.sum("n").over(run))
    at = lambda r: (F.col("cum") - F.col("n") <= F.col(r)) & (F.col(r) < F.col("cum"))
    med = (F.max(F.when(at("lo"), F.col("v"))) + F.max(F.when(at("hi"), F.col("v")))) / 2
    return cand.groupBy("g").agg(med.alias("median"))


def grouped_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """Rows ``(group, median)``: the exact median of ``value`` per group
    (nulls ignored; a group with no value is absent)."""
    return median_from_histogram(value_histogram(df, group, value)).withColumnRenamed("g", group)


def median_frame(df: DataFrame, col: str) -> DataFrame:
    """One row ``median`` of one column (null when there is no value)."""
    per = grouped_median(df.select(F.lit(0).alias("_g"), F.col(col)), "_g", col)
    # a global aggregate always yields one row, null when there is no value
    return per.agg(F.max("median").alias("median"))
