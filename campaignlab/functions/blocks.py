"""Shared building blocks (column expressions and small join helpers).

Everything here is a built-in Spark expression or join, so it stays inside
whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USER = "User_ID"

# The test account id excluded by the order-side extracts.
TEST_ACCOUNTS = ("1",)


def exclude_abnormal(df: DataFrame, abnormal: DataFrame, key: str = USER) -> DataFrame:
    """B1: drop must-not-contact users (``NOT EXISTS`` = left anti join).

    Rows with a null key are kept, as ``NOT EXISTS`` keeps them. The list is
    joined by key only; Spark picks broadcast or shuffle from its size."""
    return df.join(abnormal.select(key), on=key, how="left_anti")


def exclude_test_accounts(df: DataFrame, ids: Sequence[str] = TEST_ACCOUNTS, key: str = USER) -> DataFrame:
    """B2: drop test accounts. Like ``User_ID <> '1'`` it also drops null ids."""
    ids = list(ids)
    if len(ids) == 1:
        return df.filter(F.col(key) != F.lit(ids[0]))
    return df.filter(~F.col(key).isin(ids))


def for_audience(df: DataFrame, ids: DataFrame, key: str = USER) -> DataFrame:
    """Keep rows of users in an uploaded audience (semi join, no
    duplication even if the upload repeats ids). Spark picks broadcast or
    shuffle from the upload's size in bytes."""
    return df.join(ids.select(key), on=key, how="left_semi")


def aggregate_for_audience(rows: DataFrame, ids: DataFrame, group_by: Sequence[str], aggs: Sequence[Column],
                           key: str = USER) -> DataFrame:
    """B3 + aggregate: per-group aggregates of the rows of audience users.

    One shape at every size: other users' rows are dropped first. A shuffled
    semi join leaves the rows partitioned by ``key``, which the grouping
    (it includes ``key``) needs anyway, so there is one shuffle of the rows."""
    return for_audience(rows, ids, key).groupBy(*group_by).agg(*aggs)


def _literal_like(df: DataFrame, col: str, value) -> Column:
    """A literal of the column's own type, so the comparison is pushed down to
    the parquet scan instead of casting the column."""
    if isinstance(value, (dt.datetime, dt.date)) and not isinstance(value, dt.datetime):
        value = dt.datetime.combine(value, dt.time())
    if isinstance(value, dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(value).cast(df.schema[col].dataType)


def in_window(df: DataFrame, col: str, start, end, day_col: str | None = None) -> DataFrame:
    """Closed window ``start <= col <= end`` on a timestamp column.

    ``day_col``, when given, is a date column equal to the date of ``col``
    (a day partition column): the implied day range is added so whole
    partitions outside the window are pruned; it never changes the result."""
    if day_col is not None:
        df = df.filter(F.col(day_col).between(as_date(start), as_date(end)))
    return df.filter(F.col(col).between(_literal_like(df, col, start), _literal_like(df, col, end)))


def before(df: DataFrame, col: str, bound, day_col: str | None = None) -> DataFrame:
    """Strictly before ``bound`` (used for history before a campaign); with
    ``day_col`` as in ``in_window``."""
    if day_col is not None:
        df = df.filter(F.col(day_col) <= as_date(bound))
    return df.filter(F.col(col) < _literal_like(df, col, bound))


def as_date(value) -> Column:
    """A date literal from a date, datetime or ISO string; ``None`` means today."""
    if value is None:
        return F.current_date()
    if isinstance(value, dt.datetime):
        value = value.date()
    return F.lit(str(value)[:10]).cast("date")


def until(df: DataFrame, col: str, as_of) -> DataFrame:
    """Rows up to and including the day ``as_of`` (``None``: all rows). Rows without a date, and
    all rows of a frame without the column ``col``, count at every day."""
    if as_of is None or col not in df.columns:
        return df
    bound = F.date_add(as_date(as_of), 1).cast(df.schema[col].dataType)
    return df.filter(F.col(col).isNull() | (F.col(col) < bound))


def inactive_days(date_col: str, as_of=None) -> Column:
    """Whole days from the last activity date to ``as_of`` (an aggregate
    expression; ``as_of`` replaces the server clock, default today)."""
    return F.datediff(as_date(as_of), F.max(date_col))


DAYS_PER_MONTH = 30


def inactive_label(last: Column, start: Column) -> Column:
    """Whole 30-day months from a last order day to the start day, as the report's label."""
    days = F.datediff(start, last)
    months = ((days - days % DAYS_PER_MONTH) / DAYS_PER_MONTH).cast("int")  # toward zero, as integer division
    return F.concat(F.lit(">= "), months.cast("string"), F.lit(" month"))


def bucket(c: Column, edges: Sequence, labels: Sequence[str], equal_first: bool = False) -> Column:
    """Ordered bucket label. ``labels[i]`` for ``c <= edges[i]`` (or
    ``c == edges[0]`` when ``equal_first``), the last label otherwise; a null
    value falls through to the last label."""
    assert len(labels) == len(edges) + 1
    expr = None
    for i, (edge, label) in enumerate(zip(edges, labels)):
        cond = (c == edge) if (i == 0 and equal_first) else (c <= edge)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(labels[-1]))


def bucket_rank(c: Column, labels: Sequence[str]) -> Column:
    """Position of a bucket label, for sorting buckets in their natural order."""
    expr = None
    for i, label in enumerate(labels):
        expr = F.when(c == label, F.lit(i)) if expr is None else expr.when(c == label, F.lit(i))
    return expr.otherwise(F.lit(len(labels)))


# Money columns: two decimals, never doubles. Per-user and report totals fit
# in 18 digits; the cast raises (ANSI) rather than silently overflowing.
MONEY = "decimal(18,2)"


def money_sum(c: str) -> Column:
    return F.sum(c).cast(MONEY)


def clamp0(c: Column) -> Column:
    """Negative (and null) to zero."""
    return F.when(c > 0, c).otherwise(F.lit(0))


def avg_spend(turnover: Column, players: Column) -> Column:
    """Average spend per player, 2 decimals; null when there is no player."""
    return F.round(F.try_divide(turnover, players), 2)
