"""Consecutive numbers for the rows of a frame, without a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from campaignlab.session import ensure_checkpoint_dir


def numbered(df: DataFrame, column: str = "n") -> DataFrame:
    """``df`` with ``column`` 1, 2, 3, ... in the order of its partitions and of the rows in them
    (for an ordered frame: in its order).

    The rows are written once to the shared checkpoint folder with their place in
    their partition, so a task that runs again gives the same numbers. One count
    per partition, and their running sum, turn places into numbers; only those
    counts, one row per partition, meet in one task."""
    ensure_checkpoint_dir(df.sparkSession)
    width = 1 << 33  # monotonically_increasing_id: partition number, then 33 bits of place
    placed = df.withColumn("_at", F.monotonically_increasing_id()).checkpoint(eager=True)
    part = F.floor(F.col("_at") / F.lit(width)).cast("long")
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return (placed.withColumn("_part", part).join(starts, "_part")
            .withColumn(column, F.col("_start") + F.col("_at") % F.lit(width) + 1)
            .select(*df.columns, column))
