"""Campaign activity (A2) maintained while orders arrive.

The same per (User_ID, Lottery) in-window totals as the batch
``activity_base``, computed by Structured Streaming over new order files:
stream-static semi join with the audience, then a running aggregate. Orders
outside the campaign window are filtered before the state store, so state is
bounded by audience x products (no watermark needed: the grouping has no time
key). Each trigger writes the result table through ``foreachBatch`` to one of
two folders in turn and then notes its number, so ``current_activity`` reads
the last whole result while the next is written; progress and state live in
the checkpoint location, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from campaignlab.functions.blocks import USER, for_audience, in_window, money_sum
from campaignlab.sources.snapshots import part_number
from campaignlab.sources.tables import SCHEMAS


UPSERT_PART = "user_part"


def orders_schema() -> T.StructType:
    return T.StructType([T.StructField(c, t, True) for c, t in SCHEMAS["fact_orders"].items()])


def activity_stream(orders: DataFrame, ids: DataFrame, start, end) -> DataFrame:
    """Streaming (or batch) per (User_ID, Lottery) in-window totals of the
    audience ``ids`` (a static frame)."""
    o = in_window(orders.select(USER, "Lottery", "Entries", "Turnover", "Prize", "Creation_date"),
                  "Creation_date", start, end)
    return for_audience(o, ids).groupBy(USER, "Lottery").agg(
        F.sum("Entries").alias("Ticket_sold"),
        money_sum("Turnover").alias("Turnover"),
        money_sum("Prize").alias("Prize"))


def start_activity_monitor(spark: SparkSession, orders_path: str, ids: DataFrame, start, end, out_path: str,
                           checkpoint_location: str, trigger_seconds: int = 60,
                           max_files_per_trigger: int | None = None, upsert_parts: int | None = None) -> StreamingQuery:
    """Run ``activity_stream`` over parquet order files landing in
    ``orders_path``; ``current_activity(spark, out_path)`` gives the totals of
    the last finished trigger.

    By default a trigger writes all totals. With ``upsert_parts`` it gets only the totals
    that changed and replaces them in a table of so many folders by user, of which it
    rewrites those it touches: for audiences of all users. A trigger that runs again
    writes the same totals again."""
    reader = spark.readStream.schema(orders_schema())
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    agg = activity_stream(reader.parquet(orders_path), ids, start, end)

    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/totals-{epoch_id % 2}")
        batch.sparkSession.range(epoch_id, epoch_id + 1, 1, 1).write.mode("append").parquet(f"{out_path}/finished")

    def upsert(batch: DataFrame, epoch_id: int) -> None:
        changed = batch.withColumn(UPSERT_PART, part_number(USER, upsert_parts)).persist()
        touched = [r[0] for r in changed.select(UPSERT_PART).distinct().collect()]  # at most upsert_parts
        if touched:
            rows = changed
            try:
                old = batch.sparkSession.read.schema(changed.schema).parquet(f"{out_path}/upserts")
            except AnalysisException as e:  # the first totals find no table
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
            else:
                rows = (old.filter(F.col(UPSERT_PART).isin(touched)).join(changed.select(USER, "Lottery"), [USER, "Lottery"], "left_anti")
                        .select(changed.columns).unionByName(changed))
            rows.hint("rebalance", UPSERT_PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
                .partitionBy(UPSERT_PART).parquet(f"{out_path}/upserts")
        changed.unpersist()

    if upsert_parts:
        return (agg.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint_location)
                .trigger(processingTime=f"{trigger_seconds} seconds").start())
    return (agg.writeStream.outputMode("complete").foreachBatch(write)
            .option("checkpointLocation", checkpoint_location)
            .trigger(processingTime=f"{trigger_seconds} seconds").start())


def current_activity(spark: SparkSession, out_path: str) -> DataFrame:
    """The totals written by the last finished trigger of the monitor. Read it
    before two more triggers end: then its folder is written again."""
    last = spark.read.parquet(f"{out_path}/finished").agg(F.max("id")).first()[0]
    return spark.read.parquet(f"{out_path}/totals-{last % 2}")


def upserted_activity(spark: SparkSession, out_path: str) -> DataFrame:
    """The totals kept by a monitor with ``upsert_parts``."""
    return spark.read.parquet(f"{out_path}/upserts").drop(UPSERT_PART)
