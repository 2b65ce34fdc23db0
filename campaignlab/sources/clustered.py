"""Tables clustered by user (I5): bucketed and sorted by ``User_ID``.

Facts stored in the same number of buckets by ``User_ID`` meet without a shuffle:
per-user aggregates, the join of several of them and the anti join with the
must-exclude list read bucket against bucket. The tables are external parquet
tables; their columns and bucket numbers stand in a small table ``layout`` beside them, so
another session registers them again from the folder alone.

Day folders (``save_tables``) serve campaign windows, clustered tables serve
lifetime totals; a deployment that runs both keeps both.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from campaignlab.functions.blocks import USER
from campaignlab.sources.tables import TABLE_NAMES, CampaignTables, validate

# Stored tables that hold a user per row.
BY_USER = ("users", "orders", "orders_summary", "deposits", "withdrawals", "refunds", "rfm", "abnormal")

WALLET = ("deposits", "orders_summary", "withdrawals", "refunds")


def save_clustered(t: CampaignTables, path: str, buckets: int = 200, only: Sequence[str] = BY_USER) -> None:
    """Write the tables ``only`` (attribute names) clustered by user, one file a bucket.

    The rows are shuffled by user once, here. Rows of one user share a bucket, so a
    bucket is as large as its largest user at least: choose ``buckets`` by the
    size wanted for the others."""
    if buckets < 1:
        raise ValueError("buckets must be >= 1")
    unknown = set(only) - set(BY_USER)
    if unknown:
        raise ValueError(f"not stored by user: {sorted(unknown)}")
    path = path.rstrip("/")
    spark = t.users.sparkSession
    for attr in only:
        name = f"save_{uuid.uuid4().hex}"
        try:
            getattr(t, attr).repartition(buckets, USER).write.mode("overwrite").format("parquet") \
                .bucketBy(buckets, USER).sortBy(USER).option("path", f"{path}/{TABLE_NAMES[attr]}").saveAsTable(name)
        finally:
            spark.sql(f"drop table if exists {name}")  # external: the files stay
    layout = [(a, buckets, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in getattr(t, a).schema)) for a in only]
    spark.createDataFrame(layout, "name string, buckets int, columns string").coalesce(1) \
        .write.mode("overwrite").parquet(f"{path}/layout")


def read_clustered(spark: SparkSession, path: str, attr: str, buckets: int, columns: str) -> DataFrame:
    """One stored table, registered in this session as an external table with its buckets."""
    at = f"{path.rstrip('/')}/{TABLE_NAMES[attr]}"
    name = f"by_user_{uuid.uuid4().hex}"
    quoted = at.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"create table {name} ({columns}) using parquet clustered by ({USER}) sorted by ({USER}) "
              f"into {buckets} buckets location '{quoted}'")
    return spark.table(name)


def load_clustered(spark: SparkSession, path: str, base: CampaignTables) -> CampaignTables:
    """``base`` with every table that is stored under ``path`` read from there."""
    layout = spark.read.parquet(f"{path.rstrip('/')}/layout").collect()  # a row a table
    frames = {r["name"]: validate(read_clustered(spark, path, r["name"], r["buckets"], r["columns"]), TABLE_NAMES[r["name"]])
              for r in layout}
    wallet = {r["buckets"] for r in layout if r["name"] in WALLET}
    return replace(base, **frames, by_user=set(WALLET) <= set(frames) and len(wallet) == 1)
