"""User snapshots that are rewritten in part (U4, U5 on stored tables).

The user table is stored in folders by a hash of ``User_ID``. The number of folders
is part of the folder column's name (``user_part_64=13``), so a reader needs no
other record of it. An update reads and rewrites only the folders that hold an
uploaded id: their numbers (at most one per folder) prune the scan, and dynamic
partition overwrite replaces those folders alone when the job commits. The
updates set values, so one that was cut off during the commit is run again.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from campaignlab.functions.blocks import USER
from campaignlab.operators import status as S

PART = re.compile(r"user_part_(\d+)")


def part_number(key: str | Column, parts: int) -> Column:
    """Folder of an id (a null id has one too)."""
    c = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.xxhash64(c.cast("string")), F.lit(parts)).cast("int")


def save_snapshot(users: DataFrame, path: str, parts: int = 64) -> None:
    """Write ``users`` into ``parts`` folders, overwriting ``path``. At scale, choose
    ``parts`` so that a folder holds a few files of some 100 MB."""
    if parts < 1:
        raise ValueError("parts must be >= 1")
    name = f"user_part_{parts}"
    users.withColumn(name, part_number(USER, parts)).hint("rebalance", name).write.mode("overwrite").partitionBy(name).parquet(path)


def _stored(spark: SparkSession, path: str) -> tuple[DataFrame, str, int]:
    df = spark.read.parquet(path)
    for c in df.columns:
        if m := PART.fullmatch(c):
            return df, c, int(m[1])
    raise ValueError(f"{path}: not a snapshot in folders by user")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The stored users, without the folder column."""
    df, name, _ = _stored(spark, path)
    return df.drop(name)


def touched_parts(ids: Sequence[DataFrame], parts: int) -> list[int]:
    """Folders that can hold one of the ids (one text column each): at most ``parts`` numbers."""
    every = [d.select(part_number(F.trim(d[d.columns[0]].cast("string")), parts).alias("part")).filter(
        d[d.columns[0]].isNotNull()) for d in ids]
    out = every[0]
    for d in every[1:]:
        out = out.unionByName(d)
    return sorted(r["part"] for r in out.distinct().collect())


def rewrite_parts(spark: SparkSession, path: str, touched: Sequence[int], change) -> list[int]:
    """Replace those of the ``touched`` folders in which ``change(their users)`` alters a row;
    it must keep ids, and columns it does not know. No other folder is read, no unchanged
    one written. Returns the folders replaced."""
    df, name, parts = _stored(spark, path)
    touched = sorted(set(touched))
    if not touched:
        return []
    columns = [c for c in df.columns if c != name]
    old = df.filter(F.col(name).isin(touched))
    differs = change(old.withColumn("_before", F.struct(*columns))).filter(~F.struct(*columns).eqNullSafe(F.col("_before")))
    changed = sorted(r["part"] for r in differs.select(part_number(USER, parts).alias("part")).distinct().collect())
    if not changed:
        return []
    new = change(df.filter(F.col(name).isin(changed)).select(columns)).withColumn(name, part_number(USER, parts))
    new.hint("rebalance", name).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)
    return changed


def update_snapshot(spark: SparkSession, path: str, rg_limit: DataFrame | None = None, opt_out: DataFrame | None = None,
                    user_status: DataFrame | None = None, rg_id_column: str = S.RG_UPLOAD_ID,
                    status_id_column: str = S.STATUS_UPLOAD_ID, status_column: str = S.STATUS_UPLOAD_VALUE,
                    on_conflict: str = "error") -> list[int]:
    """U1-U3, U5 on a stored snapshot: apply the uploads that are given, in the
    reference order, and rewrite only the folders in which a user changes. Returns the
    folders rewritten. A conflicting status upload fails before anything is replaced."""
    _, _, parts = _stored(spark, path)
    ids = []
    if rg_limit is not None:
        ids.append(rg_limit.select(rg_id_column))
    if opt_out is not None:
        ids.append(opt_out.select(USER if USER in opt_out.columns else "user_id"))
    if user_status is not None:
        ids.append(user_status.select(status_id_column))
    if not ids:
        return []

    def change(users: DataFrame) -> DataFrame:
        if rg_limit is not None:
            users = S.apply_rg_limit(users, rg_limit, rg_id_column)
        if opt_out is not None:
            users = S.apply_opt_out(users, opt_out)
        if user_status is not None:
            users = S.apply_user_status(users, user_status, status_id_column, status_column, on_conflict)
        return users

    return rewrite_parts(spark, path, touched_parts(ids, parts), change)


