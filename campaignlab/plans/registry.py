"""Registry of named, parameterised queries.

Each entry pairs a Spark builder ``fn(TestData) -> DataFrame`` with the
equivalent DuckDB SQL over the test-data tables (the campaign views inlined as
a WITH list). ``__spark_entry__`` exposes both; the tests compare them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from campaignlab.sources.fixtures import TestData, duckdb_with


@dataclass(frozen=True)
class QuerySpec:
    name: str
    build: Callable[[TestData], DataFrame]
    views: tuple[str, ...]
    sql: str | None  # body after the WITH list; None = no SQL equivalent

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(TestData(spark, sf_dir))

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        return duckdb_with(list(self.views)) + "\n" + self.sql.strip()


REGISTRY: dict[str, QuerySpec] = {}


def query(name: str, views: tuple[str, ...] | list[str], sql: str | None):
    """Decorator registering a builder under ``name``."""
    def deco(fn: Callable[[TestData], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = QuerySpec(name, fn, tuple(views), sql)
        return fn
    return deco


# SQL text of the must-not-contact exclusion, after a FROM item with a User_ID (a null id stays).
CONTACTABLE = "anti join vw_abnormal_users using (User_ID)"
