"""Exact top-k search by Fagin's threshold algorithm.

A block of candidates keeps, for each dimension, its rows in the order of that
component. A query walks the lists of its non-zero components side by side, from
the end that adds most to its score; each row met is scored in full. No row still
unseen can score above the threshold, the score of the components just read, so
the walk stops once the kth best score lies above it. Blocks give their k best,
and a window by query keeps the k best of all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campaignlab.llm.vectors import answers, blocks_of, by_block, by_id, matrix, same_width, whole_vectors


class SortedLists:
    """Rows of an integer matrix, in the order that settles ties, as sorted lists."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.order = np.ascontiguousarray(np.argsort(rows, axis=0, kind="stable").T.astype(np.int32))  # by dimension, ascending
        self.most = int(np.abs(rows).max(initial=0))
        self.exact: dict = {}
        self.walked = 0  # rows scored

    def typed(self, bound: int) -> np.ndarray:
        """The matrix in the cheapest type in which scores up to ``bound`` are exact."""
        if bound >= 2**63:
            raise ValueError(f"scores up to {bound} do not fit 64 bits")
        kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
        if kind not in self.exact:
            self.exact[kind] = self.rows.astype(kind)
        return self.exact[kind]

    def search(self, query: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the ``k`` best rows (all, if fewer) but row ``without``."""
        n = len(self.rows)
        rows = self.typed(int(np.abs(query).sum()) * self.most)
        q = query.astype(rows.dtype)
        dims = np.flatnonzero(query)
        lists, up = self.order if len(dims) == len(query) else self.order[dims], query[dims] < 0
        seen = np.zeros(n, bool)
        if 0 <= without < n:
            seen[without] = True
        stamp = np.empty(n, np.int32)
        best, scores = np.zeros(0, np.int64), np.zeros(0, rows.dtype)
        depth, to = 0, min(n, 16) if len(dims) else n
        while depth < n:
            if len(dims):  # places depth to `to` from the best end of each list
                ahead = np.where(up[:, None], np.arange(depth, to), np.arange(n - 1 - depth, n - 1 - to, -1))
                met = np.take_along_axis(lists, ahead, 1).ravel()
            else:
                met = np.arange(n)  # a query of zeros: all scores tie
            met = met[~seen[met]]
            count = np.arange(len(met), dtype=np.int32)
            stamp[met] = count
            met = met[stamp[met] == count].astype(np.int64)  # each row once
            seen[met] = True
            self.walked += len(met)
            scores = np.concatenate([scores, rows[met] @ q])
            best = np.concatenate([best, met])
            if len(best) > k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                at = np.flatnonzero(scores >= kth)
                at = at[np.lexsort((best[at], -scores[at]))][:k]
                best, scores = best[at], scores[at]
            depth = to
            if len(best) == k and len(dims):
                last = lists[np.arange(len(dims)), np.where(up, depth - 1, n - depth)]
                if scores.min() > rows[last, dims] @ q[dims]:
                    break
            if seen.all():
                break
            to = min(n, depth * 2)
        at = np.lexsort((best, -scores))
        return best[at], scores[at].astype(np.int64)


def top_k(table: DataFrame, queries: Callable[[Column], Column], k: int = 5, id: str = "vec_id", vec: str = "embedding",
          scale: int = 256) -> DataFrame:
    """The ``k`` rows with the highest inner product for each row that satisfies ``queries``
    (a function of the id column): query_id, rank (from 1), vec_id, score, query_uid (one for each
    query row). All other rows are candidates; ties go to the smaller id.

    Components are floor(scale * x) of x as double. Rows whose vector is null or
    holds a null or non-finite component take no part; a null id is no query and loses
    every tie; an empty vector scores 0, a shorter one as if it ended in zeros.
    Rows that repeat an id are queries and candidates each. Fewer than ``k`` other
    rows: all of them; an empty table: no rows. Other columns are not read. The
    job fails if a component leaves 32 bits or a score could leave 64."""
    rows = whole_vectors(table, id, vec, scale=scale)
    asked = rows.filter(queries(F.col("id")))
    stream = by_block(rows, asked, blocks_of(rows.count()))

    def build(candidates):
        t = by_id(candidates)
        return t["uid"].to_numpy(), t["id"].combine_chunks(), matrix(t["vec"]), {}

    def ask(index, batch):
        import pyarrow as pa

        uid, ids, rows, made = index
        asks, wide = same_width(matrix(batch.column("vec")), rows)
        if made.get("width") != wide.shape[1]:
            made.update(width=wide.shape[1], lists=SortedLists(wide), own={u: r for r, u in enumerate(uid.tolist())})
        own = batch.column("uid").to_numpy()
        found = [made["lists"].search(q, k, made["own"].get(u, -1)) for q, u in zip(asks, own.tolist())]
        at = np.repeat(np.arange(len(found)), [len(r) for r, _ in found])
        hit = np.concatenate([r for r, _ in found])
        return pa.RecordBatch.from_arrays(
            [pa.array(own[at]), batch.column("id").take(pa.array(at)), ids.take(pa.array(hit)), pa.array(uid[hit]),
             pa.array(np.concatenate([s for _, s in found]))], ["query_uid", "query_id", "vec_id", "uid", "score"])

    def search(batches: Iterator) -> Iterator:
        return answers(batches, build, ask, 1024)

    found = stream.mapInArrow(search, "query_uid long, query_id long, vec_id long, uid long, score long")
    w = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score", "query_uid")
