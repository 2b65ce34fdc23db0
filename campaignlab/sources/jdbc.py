"""JDBC source (I2) and append sink (I3) for warehouses that keep the facts.

The reference reads every query result through a single JDBC connection; here
a table read can be split into ``num_partitions`` parallel range queries on a
numeric/date column, and writes go out from every task in batches. The JDBC
driver jar must be on the cluster classpath.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def read_jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None,
              driver: str | None = None, properties: Mapping[str, str] | None = None,
              partition_column: str | None = None, lower_bound=None, upper_bound=None,
              num_partitions: int | None = None, fetch_size: int = 10_000) -> DataFrame:
    """A table or query as a DataFrame. Filters and column selections of
    later DataFrame steps are pushed into the generated SQL."""
    if (table is None) == (query is None):
        raise ValueError("give exactly one of table or query")
    r = spark.read.format("jdbc").option("url", url).option("fetchsize", str(fetch_size))
    r = r.option("dbtable", table) if table is not None else r.option("query", query)
    if driver:
        r = r.option("driver", driver)
    if partition_column is not None:
        if table is None:
            raise ValueError("partitioned reads need a table (Spark does not split a query option)")
        if None in (lower_bound, upper_bound, num_partitions):
            raise ValueError("partitioned reads need lower_bound, upper_bound and num_partitions")
        r = (r.option("partitionColumn", partition_column).option("lowerBound", str(lower_bound))
             .option("upperBound", str(upper_bound)).option("numPartitions", str(num_partitions)))
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    return r.load()


def write_jdbc(df: DataFrame, url: str, table: str, driver: str | None = None,
               properties: Mapping[str, str] | None = None, mode: str = "append",
               batch_size: int = 10_000, num_partitions: int | None = None) -> None:
    """Append (or overwrite) a DataFrame into a table; ``num_partitions``
    caps concurrent connections."""
    w = df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", str(batch_size))
    if driver:
        w = w.option("driver", driver)
    if num_partitions:
        w = w.option("numPartitions", str(num_partitions))
    for k, v in (properties or {}).items():
        w = w.option(k, v)
    w.mode(mode).save()


def load_tables_jdbc(spark: SparkSession, url: str, schema: str = "dbo", driver: str | None = None,
                     properties: Mapping[str, str] | None = None,
                     partitions: Mapping[str, tuple[str, object, object, int]] | None = None):
    """The campaign table set read from a warehouse over JDBC (the reference's
    ``dbo.*`` tables and ``vw_abnormal_users`` view). ``partitions`` maps a
    table name to ``(column, lower, upper, num_partitions)`` for parallel
    range reads of the large facts; other tables are read in one query."""
    from campaignlab.sources.tables import TABLE_NAMES, CampaignTables, validate

    partitions = partitions or {}
    for name, spec in partitions.items():  # fail before opening any connection
        if name not in TABLE_NAMES.values():
            raise ValueError(f"unknown table {name!r}")
        if len(spec) != 4 or None in spec:
            raise ValueError(f"{name}: partitions need (column, lower, upper, num_partitions)")
    frames = {}
    for attr, name in TABLE_NAMES.items():
        col, lo, hi, n = partitions.get(name, (None, None, None, None))
        df = read_jdbc(spark, url, table=f"{schema}.{name}", driver=driver, properties=properties,
                       partition_column=col, lower_bound=lo, upper_bound=hi, num_partitions=n)
        frames[attr] = validate(df, name)
    return CampaignTables(**frames)
