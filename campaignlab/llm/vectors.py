"""Whole-number vectors and the dealing of queries over blocks of candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignlab.llm.common import materialize


def whole_vectors(table: DataFrame, id: str, vec: str, *extra: str, scale: int = 256) -> DataFrame:
    """Rows ``uid`` (unlike for every row), ``id`` (long), the columns ``extra`` and ``vec``:
    floor(scale * x) of each component x, as double.

    Rows whose vector is null or holds a null or non-finite component are left
    out. The job fails if a component leaves 32 bits."""
    ok = F.forall(F.col(f"`{vec}`"), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = table.filter(F.col(f"`{vec}`").isNotNull() & ok).select(
        F.col(f"`{id}`").cast("long").alias("id"), *extra,
        F.transform(F.col(f"`{vec}`"), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("int")).alias("vec"))
    return materialize(rows.select(F.monotonically_increasing_id().alias("uid"), "*"))


def blocks_of(n: int, least: int = 2048, most: int = 65536, parts: int = 16) -> int:
    """How many blocks ``n`` candidates are dealt into: ``parts``, while blocks have ``least`` to ``most`` rows."""
    return -(-n // min(most, max(least, -(-n // parts)))) if n else 1


def by_block(candidates: DataFrame, queries: DataFrame, blocks: int) -> DataFrame:
    """Each block's candidates (``asks`` 0), dealt by hash, then all queries (``asks`` 1).

    A task holds one block and streams the queries by, so its memory is bound by
    the block, however many queries there are."""
    dealt = candidates.select(F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "*")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "*")
    return dealt.unionByName(asked, allowMissingColumns=True).repartition(2 * blocks, "block") \
        .sortWithinPartitions("block", "asks", "uid")


def answers(batches: Iterator, build: Callable, ask: Callable, at_once: int) -> Iterator:
    """Over the rows of ``by_block``: ``ask(index, queries)`` for up to ``at_once`` queries at
    a time, with the ``index`` that ``build`` made of their block's candidates."""
    import pyarrow as pa

    held, index, block = [], None, None
    for b in batches:
        key = b.column("block").to_numpy().astype(np.int64) * 2 + b.column("asks").to_numpy()
        cut = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(key)]):
            if key[lo] // 2 != block:
                held, index, block = [], None, key[lo] // 2
            if key[lo] % 2 == 0:
                held.append(b.slice(lo, hi - lo))
                continue
            if held:
                index, held = build(pa.Table.from_batches(held).combine_chunks()), []
            for k in range(lo, hi, at_once) if index is not None else ():
                yield ask(index, b.slice(k, min(at_once, hi - k)))


def matrix(column) -> np.ndarray:
    """Arrow list column as a matrix of int64; shorter vectors end in zeros."""
    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy().astype(np.int64)
    width = int(size.max(initial=0))
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def by_id(table):
    """Rows in the order that settles ties: id (null last), then uid."""
    import pyarrow.compute as pc

    return table.take(pc.sort_indices(table, sort_keys=[("id", "ascending"), ("uid", "ascending")], null_placement="at_end"))
