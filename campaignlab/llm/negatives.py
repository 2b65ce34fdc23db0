"""Hard-negative mining with scores from a residue number system.

The inner products of a block are float32 matrix products of balanced residues
modulo several small primes, small enough that every sum of products stays below
2**24 and is exact. The residues of a score give its signed value by Chinese
remaindering in mixed radix. One pass finds each anchor's positives, a second
picks, for each positive, the negatives inside its window of scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campaignlab.llm.vectors import answers, blocks_of, by_block, by_id, matrix, same_width, whole_vectors

SEGMENT = 1024  # dimensions summed in float32 at a time


def primes_for(width: int) -> list[int]:
    """Primes, largest first, whose balanced residues have exact float32 sums over ``width`` products,
    as many as fit a product below 2**62."""
    most = 2 * int((2**24 / max(1, min(width, SEGMENT))) ** 0.5) - 1
    out, product = [], 1
    for p in range(min(most, 4093), 2, -1):
        if product * p < 2**62 and all(p % d for d in range(2, int(p**0.5) + 1)):
            out.append(p)
            product *= p
    return out


class Residues:
    """An integer matrix and its balanced residues modulo the primes, made when asked for."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.made = rows, {}
        self.most = int(np.abs(rows).max(initial=0))

    def mod(self, p: int) -> np.ndarray:
        if p not in self.made:
            r = self.rows % p
            self.made[p] = np.where(r > p // 2, r - p, r).astype(np.float32)
        return self.made[p]


def products(a: Residues, b: Residues) -> np.ndarray:
    """Exact int64 inner products of all rows of ``a`` and ``b``."""
    width = a.rows.shape[1]
    bound, primes, product = 2 * width * a.most * b.most + 1, [], 1
    for p in primes_for(width):
        if product > bound and primes:
            break
        primes.append(p)
        product *= p
    if product <= bound:
        raise ValueError(f"scores up to {bound // 2} are beyond the residue system")
    # mixed radix: score = d0 + d1 p0 + d2 p0 p1 + ..., one digit for each prime
    value, scale = np.zeros((len(a.rows), len(b.rows)), np.int64), 1
    for p in primes:
        x, y, r = a.mod(p), b.mod(p), np.zeros(value.shape, np.int64)
        for lo in range(0, width, SEGMENT):
            r += (x[:, lo:lo + SEGMENT] @ y[:, lo:lo + SEGMENT].T).astype(np.int64)
        value += (r - value) % p * pow(scale, -1, p) % p * scale
        scale *= p
    value[value > product // 2] -= product
    return value


def first(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, higher first, ties by place."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return at[np.argsort(-scores[at], kind="stable")][:k]
    return np.argsort(-scores, kind="stable")


def hard_negatives(table: DataFrame, anchors: Callable[[Column], Column], positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   id: str = "vec_id", vec: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """For each anchor (a row whose id satisfies ``anchors``, a function of the id column) and each of its
    ``positives`` best other rows of its label, the ``negatives`` best rows of another label with
    low * positive_score <= 100 * negative_score <= high * positive_score: anchor_id, positive_id,
    rank (from 1), negative_id, positive_score, negative_score.

    Scores are inner products of floor(scale * x), x as double; ties go to the
    smaller id (null last). Rows with a null label, a null vector or a null or non-finite
    component take no part. Rows that repeat an id take part each; a null id is no
    anchor. Fewer rows than asked for: all; an empty window, a negative positive_score or no
    positive: no rows. A shorter vector counts as if it ended in zeros. Other
    columns are not read. The job fails if a component leaves 32 bits or a score
    could reach 2**60."""
    rows = whole_vectors(table.filter(F.col(f"`{label}`").isNotNull()), id, vec,
                         F.col(f"`{label}`").cast("long").alias("label"), scale=scale)
    blocks = blocks_of(rows.count())
    asked = rows.filter(anchors(F.col("id")))

    def build(candidates):
        t = by_id(candidates)
        return {"uid": t["uid"].to_numpy(), "id": t["id"].combine_chunks(), "label": t["label"].to_numpy(), "rows": matrix(t["vec"])}

    def scored(index: dict, batch) -> np.ndarray:
        asks, wide = same_width(matrix(batch.column("vec")), index["rows"])
        if "residues" not in index or index["residues"].rows.shape[1] != wide.shape[1]:
            index["residues"] = Residues(wide)
        return products(Residues(asks), index["residues"])

    def ask_positives(index: dict, batch):
        import pyarrow as pa

        scores, own = scored(index, batch), batch.column("uid").to_numpy()
        at, hit = [], []
        for r, (u, y) in enumerate(zip(own, batch.column("label").to_numpy())):
            same = np.flatnonzero((index["label"] == y) & (index["uid"] != u))
            got = same[first(scores[r, same], positives)]
            at += [r] * len(got)
            hit.append(got)
        at, hit = np.array(at, np.int64), np.concatenate(hit)
        return pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(index["uid"][hit]), index["id"].take(pa.array(hit)),
                                           pa.array(scores[at, hit])], ["uid", "positive_uid", "positive_id", "positive_score"])

    def ask_negatives(index: dict, batch):
        import pyarrow as pa

        scores, own = scored(index, batch), batch.column("uid").to_numpy()
        chosen = batch.column("chosen")
        ends = np.concatenate([[0], np.cumsum(chosen.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        wanted = chosen.flatten().field("positive_score").to_numpy()
        at, hit = [], []  # places in `wanted`, rows of the block
        for r, y in enumerate(batch.column("label").to_numpy()):
            other = np.flatnonzero(index["label"] != y)
            other = other[np.argsort(-scores[r, other], kind="stable")]
            down = -scores[r, other]
            for c in range(ends[r], ends[r + 1]):
                p = int(wanted[c])
                if p < 0:
                    continue
                lo = np.searchsorted(down, -(high * p // 100), "left")  # 100 n <= high p
                hi = np.searchsorted(down, low * -p // 100, "right")  # 100 n >= low p
                got = other[lo:min(hi, lo + negatives)]
                at += [c] * len(got)
                hit.append(got)
        at = np.array(at, np.int64)
        hit = np.concatenate([*hit, np.zeros(0, np.int64)]).astype(np.int64)
        r = np.searchsorted(ends, at, "right") - 1
        picked = chosen.flatten().take(pa.array(at))
        return pa.RecordBatch.from_arrays(
            [pa.array(own[r]), batch.column("id").take(pa.array(r)), picked.field("positive_uid"), picked.field("positive_id"),
             picked.field("positive_score"), index["id"].take(pa.array(hit)), pa.array(index["uid"][hit]),
             pa.array(scores[r, hit])],
            ["uid", "anchor_id", "positive_uid", "positive_id", "positive_score", "negative_id", "negative_uid", "negative_score"])

    def find_positives(batches: Iterator) -> Iterator:
        return answers(batches, build, ask_positives, 64)

    def find_negatives(batches: Iterator) -> Iterator:
        return answers(batches, build, ask_negatives, 64)

    found = by_block(rows, asked, blocks).mapInArrow(
        find_positives, "uid long, positive_uid long, positive_id long, positive_score long")
    w = Window.partitionBy("uid").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"), "positive_uid")
    best = found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= positives)
    chosen = best.groupBy("uid").agg(F.collect_list(F.struct("positive_uid", "positive_id", "positive_score")).alias("chosen"))
    mined = by_block(rows, asked.join(chosen, "uid"), blocks).mapInArrow(
        find_negatives, "uid long, anchor_id long, positive_uid long, positive_id long, positive_score long, "
                        "negative_id long, negative_uid long, negative_score long")
    w = Window.partitionBy("uid", "positive_uid").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "negative_uid")
    return mined.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
