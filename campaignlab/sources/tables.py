"""The campaign table set: schemas, loading and validation.

Production data lives as one parquet dataset per table (facts ideally
partitioned by date so time windows prune files). ``load_tables`` reads such a
folder; ``TestData`` in ``fixtures`` derives the same tables from the star
schema test data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Column contract per table (name -> Spark type). User_ID is always a string.
SCHEMAS: dict[str, dict[str, T.DataType]] = {
    "dim_user_authentication": {
        "User_ID": T.StringType(), "registerTime": T.TimestampNTZType(), "verification_status": T.StringType(),
        "nationality": T.StringType(), "attempt_depo": T.IntegerType(), "FTD": T.DateType(), "FTP": T.DateType(),
        "user_status": T.StringType(), "RG_limit": T.IntegerType(), "receive_mail": T.IntegerType(),
        "receive_message": T.IntegerType(), "receive_sms": T.IntegerType(),
    },
    "fact_orders": {
        "User_ID": T.StringType(), "GameID": T.IntegerType(), "Lottery": T.StringType(),
        "Creation_date": T.TimestampNTZType(), "DateID": T.DateType(), "Draw_Period": T.IntegerType(),
        "Series_No": T.IntegerType(), "Entries": T.LongType(), "Turnover": T.DecimalType(18, 2),
        "Prize": T.DecimalType(18, 2),
    },
    "fact_orders_summary": {
        "User_ID": T.StringType(), "GameID": T.IntegerType(), "DateID": T.DateType(), "Draw_Period": T.IntegerType(),
        "Game_series": T.StringType(), "Orders": T.LongType(), "Entries": T.LongType(),
        "Turnover": T.DecimalType(18, 2), "Prize": T.DecimalType(18, 2),
    },
    "dim_games": {"GameID": T.IntegerType(), "Lottery": T.StringType(), "Unit_Price": T.IntegerType()},
    "fact_deposit": {
        "User_ID": T.StringType(), "top_up_id": T.LongType(), "top_up_amount": T.DecimalType(18, 2),
        "top_up_state": T.StringType(), "creation_date": T.TimestampNTZType(), "gateway_memo": T.StringType(),
    },
    "dim_fail_deposit_group": {"gateway_memo": T.StringType(), "fail_group": T.StringType()},
    "fact_withdraw": {
        "User_ID": T.StringType(), "withdrawal_amount": T.DecimalType(18, 2), "withdrawal_status": T.StringType(),
    },
    "fact_refund": {"User_ID": T.StringType(), "Refund_amount": T.DecimalType(18, 2), "Memo": T.StringType()},
    "rfm_score": {"User_ID": T.StringType(), "Segment": T.StringType()},
    "vw_abnormal_users": {"User_ID": T.StringType()},
}

# attribute name on CampaignTables -> table name
TABLE_NAMES = {
    "users": "dim_user_authentication",
    "orders": "fact_orders",
    "orders_summary": "fact_orders_summary",
    "games": "dim_games",
    "deposits": "fact_deposit",
    "fail_groups": "dim_fail_deposit_group",
    "withdrawals": "fact_withdraw",
    "refunds": "fact_refund",
    "rfm": "rfm_score",
    "abnormal": "vw_abnormal_users",
}


class SchemaError(ValueError):
    pass


def validate(df: DataFrame, table: str, strict_types: bool = False) -> DataFrame:
    """Check that ``df`` carries every column the operators read.

    Missing columns raise; with ``strict_types`` a differing type raises too.
    Only the schema is inspected (no Spark job)."""
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [c for c in SCHEMAS[table] if c not in have]
    if missing:
        raise SchemaError(f"{table}: missing columns {missing}")
    if strict_types:
        bad = {c: (str(have[c]), str(t)) for c, t in SCHEMAS[table].items()
               if not _type_compatible(have[c], t)}
        if bad:
            raise SchemaError(f"{table}: column types differ {bad}")
    return df


def _type_compatible(have: T.DataType, want: T.DataType) -> bool:
    if isinstance(want, T.DecimalType):
        return isinstance(have, T.DecimalType) and have.scale == want.scale
    if isinstance(want, (T.TimestampNTZType, T.TimestampType)):
        return isinstance(have, (T.TimestampNTZType, T.TimestampType))
    return type(have) is type(want)


@dataclass(frozen=True)
class CampaignTables:
    """The tables every operator reads. All are lazy DataFrames."""

    users: DataFrame
    orders: DataFrame
    orders_summary: DataFrame
    games: DataFrame
    deposits: DataFrame
    fail_groups: DataFrame
    withdrawals: DataFrame
    refunds: DataFrame
    rfm: DataFrame
    abnormal: DataFrame
    # Day column the orders are stored partitioned by, equal to the date of
    # ``Creation_date`` (as ``save_tables`` writes them). Time windows then
    # also filter it, which prunes whole day folders. None: no such column.
    orders_day: str | None = None
    # Deposits, orders summary, withdrawals and refunds are clustered by user in
    # equally many buckets (``sources.clustered``): per-user results need no shuffle.
    by_user: bool = False

    def validated(self, strict_types: bool = False) -> "CampaignTables":
        for f in fields(self):
            if f.name in TABLE_NAMES:
                validate(getattr(self, f.name), TABLE_NAMES[f.name], strict_types)
        return self

    def with_users(self, users: DataFrame) -> "CampaignTables":
        """A new table set after a user-status update: the must-exclude list
        follows the updated snapshot."""
        from campaignlab.operators.audience import abnormal_users

        return replace(self, users=users, abnormal=abnormal_users(users))


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return spark.read.schema(T.StructType([T.StructField(c, t) for c, t in SCHEMAS[table].items()])).parquet(path)


def load_tables(spark: SparkSession, path: str, derive_abnormal: bool = False, orders_day: str | None = "DateID",
                base: CampaignTables | None = None, only: Sequence[str] | None = None) -> CampaignTables:
    """Read ``<path>/<table>`` parquet datasets.

    The stored must-exclude list is obeyed; ``derive_abnormal`` replaces it by
    the rule over the user table (E10b) where the caller asks for that. A
    dataset written from an empty table is read with its contract schema. With ``only`` (attributes)
    the other tables are those of ``base``. ``orders_day`` names the orders' day partition column (the
    date of ``Creation_date``, as ``save_tables`` writes it); pass None for
    tables where that does not hold."""
    from campaignlab.operators.audience import abnormal_users

    path = path.rstrip("/")
    frames = {}
    for attr, name in TABLE_NAMES.items():
        if attr == "abnormal" and derive_abnormal:
            continue
        if only is not None and attr not in only:
            frames[attr] = getattr(base, attr)
            continue
        frames[attr] = validate(read_table(spark, f"{path}/{name}", name), name)
    if derive_abnormal:
        frames["abnormal"] = abnormal_users(frames["users"])
    if orders_day is not None and orders_day not in frames["orders"].columns:
        orders_day = None
    return CampaignTables(**frames, orders_day=orders_day)


# Fact tables stored partitioned by day, so time filters on the day column
# prune whole folders; the others are plain datasets.
DAY_PARTITIONED = {"fact_orders": "DateID", "fact_orders_summary": "DateID"}


def save_tables(t: CampaignTables, path: str, mode: str = "overwrite", partition_facts: bool = True,
                only: Sequence[str] | None = None) -> None:
    """Write a table set as parquet datasets readable by ``load_tables``.

    ``partition_facts=False`` writes the facts unpartitioned (small test
    sizes, where day folders would only hold tiny files); ``only`` names the
    tables (attributes) to write, if not all."""
    path = path.rstrip("/")
    for attr, name in TABLE_NAMES.items():
        if only is not None and attr not in only:
            continue
        df = getattr(t, attr)
        day = DAY_PARTITIONED.get(name) if partition_facts else None
        if day is not None:  # one task a day, or several for a large day, instead of tasks x days files
            df = df.hint("rebalance", day)
        w = df.write.mode(mode)
        if day is not None:
            w = w.partitionBy(day)
        w.parquet(f"{path}/{name}")
