"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from campaignlab.session import ensure_checkpoint_dir

ROW = "__row"  # whole input row, kept as one struct so that extra columns cannot clash


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remainder(col: str | Column, mod: int) -> Column:
    """crc32 of the value as text, modulo ``mod`` (null counts as empty text)."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % mod).cast("int")


def doc_key(doc_id: str | Column, text: str | Column) -> Column:
    """Key of a document row: its id (null sorts last) and a hash of its text.

    Rows that repeat both are the same document to every operator."""
    d = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    t = F.col(text) if isinstance(text, str) else text
    return F.struct(F.coalesce(d.cast("long"), F.lit(2**63 - 1)).alias("d"),
                    F.xxhash64(F.coalesce(t, F.lit(""))).alias("x"))


def hashed_share(df: DataFrame, rows: int, *cols: str) -> DataFrame:
    """About ``rows`` rows of ``df`` by the hash of ``cols``: all of them if there
    are no more. One count, then a filter: no sort and no task that gathers."""
    n = df.count()
    return df.filter(F.pmod(F.xxhash64(F.lit("share"), *cols), F.lit(n)) < rows) if n > rows else df


def per_worker(key: tuple, make):
    """The object ``make()`` gives, made once in a Python worker process and kept for
    its later tasks. Shipped functions carry their own globals, so it is kept in ``sys``."""
    import sys

    kept = sys.__dict__.setdefault("_campaignlab_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def text_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, null as empty."""
    import pyarrow as pa

    return [b if b is not None else b"" for b in column.cast(pa.large_binary()).to_pylist()]


def cuts(sizes, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about ``limit`` in all, at least one row each."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def slices(batch, column: str, limit: int = 2_000_000) -> Iterator:
    """Slices of an Arrow batch with about ``limit`` bytes of ``column`` each."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for lo, hi in cuts(sizes, limit):
        yield batch.slice(lo, hi - lo)
