"""Inactivity before a campaign from a maintained table of last order days.

Per user and month of ``Creation_date`` the table holds the last order day. The
months before the campaign's own come from it; of the orders only the campaign's
month up to its start is read. New orders change only the months they fall in.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campaignlab.functions.blocks import USER, as_date, before, for_audience, inactive_label
from campaignlab.sources.tables import CampaignTables


def monthly_last_days(orders: DataFrame) -> DataFrame:
    """Rows (User_ID, month, last_day): the last order day (``DateID``) of the orders created
    in a month. Orders without a creation time are before no campaign and left out."""
    month = F.trunc(F.col("Creation_date").cast("date"), "month")
    return (orders.filter(F.col("Creation_date").isNotNull()).groupBy(USER, month.alias("month"))
            .agg(F.max("DateID").alias("last_day")))


def merge_last_days(*tables: DataFrame) -> DataFrame:
    """Several tables of last days as one (equal keys take the latest day)."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy(USER, "month").agg(F.max("last_day").alias("last_day"))


def read_last_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(USER, F.col("month").cast("date").alias("month"), "last_day")


def add_orders(spark: SparkSession, path: str, orders: DataFrame) -> None:
    """Bring the stored table up to date with new ``orders``: the months they fall in are merged
    and replaced, one folder a month; other folders are neither read nor written.
    The first call makes the table. Adding the same orders twice changes nothing."""
    new = monthly_last_days(orders)
    try:
        old = read_last_days(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        months = [r["month"] for r in new.select("month").distinct().collect()]  # a handful: one row a month
        if not months:
            return
        new = merge_last_days(old.filter(F.col("month").isin(months)), new)
    (new.hint("rebalance", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("month").parquet(path))


def inactive_months_maintained(t: CampaignTables, last_days: DataFrame, ids: DataFrame, start) -> DataFrame:
    """A7 as ``activity.inactive_months`` gives it, from ``last_days`` and one month of orders."""
    first = F.trunc(as_date(start), "month")
    closed = for_audience(last_days.filter(F.col("month") < first), ids).select(USER, "last_day")
    cols = list(dict.fromkeys([USER, "DateID", "Creation_date"] + ([t.orders_day] if t.orders_day else [])))
    month = t.orders.select(*cols).filter(F.col("Creation_date") >= first.cast(t.orders.schema["Creation_date"].dataType))
    if t.orders_day:
        month = month.filter(F.col(t.orders_day) >= first)
    recent = for_audience(before(month, "Creation_date", start, day_col=t.orders_day), ids).select(
        USER, F.col("DateID").alias("last_day"))
    last = closed.unionByName(recent).groupBy(USER).agg(F.max("last_day").alias("_last"))
    return last.select(USER, inactive_label(F.col("_last"), as_date(start)).alias("inactive_month"))


def last_days_agree(last_days: DataFrame, orders: DataFrame) -> DataFrame:
    """One row a month: ``users`` that ordered in it, and whether the table and the orders
    ``agree`` on every user's last day."""
    kept = last_days.select("month", USER, F.lit(1).alias("side"), "last_day")
    facts = monthly_last_days(orders).select("month", USER, F.lit(2).alias("side"), "last_day")
    day = F.coalesce("last_day", F.lit("1900-01-01").cast("date"))
    per_user = kept.unionByName(facts).groupBy("month", USER).agg(
        F.sum("side").alias("sides"), F.min(day).alias("low"), F.max(day).alias("high"))
    return per_user.groupBy("month").agg(
        F.count(F.when(F.col("sides") >= 2, F.lit(1))).alias("users"),
        F.min((F.col("sides") == 3) & (F.col("low") == F.col("high"))).alias("agree"))
