"""SimHash near-dedup by tiled exact comparison.

Distinct fingerprints are dealt into tiles by population count and hash; two
tiles are compared with exclusive-or and bit counts only if their population
counts are within the radius, since the distance of two fingerprints is at
least the difference of their population counts. The same bound on the four
16-bit words skips blocks inside a pair of tiles. A pair of tiles returns a
spanning forest of its links, at most one row per fingerprint, so a group of
many near copies never becomes all its pairs; components are joined over all
tile pairs by repeated hooking and shortcutting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignlab.llm.common import ROW, doc_key, materialize, slices, text_bytes

SALTS = 32
LANES = 255  # hashes that eight one-byte counters in a word can sum without overflow


def bit_lanes() -> np.ndarray:
    """For each byte a word with one lane per bit, lowest bit in the lowest byte."""
    byte = np.arange(256, dtype=np.uint64)
    return sum((((byte >> np.uint64(k)) & np.uint64(1)) << np.uint64(8 * k) for k in range(8)), np.zeros(256, np.uint64))


def bit_sums(hashes: list[int], sizes: list[int]) -> np.ndarray:
    """Per stretch of ``sizes`` hashes: how many have each of the 64 bits."""
    size = np.array(sizes, np.int64)
    bytes8 = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    # cut every stretch into pieces of at most LANES hashes, sum lanes in each
    pieces = -(-size // LANES)
    first = np.repeat(np.cumsum(size) - size, pieces)
    step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    sums = np.add.reduceat(bit_lanes()[bytes8], first + step * LANES, axis=0)
    return np.add.reduceat(sums.view(np.uint8).reshape(-1, 64), np.cumsum(pieces) - pieces, axis=0, dtype=np.int64)


def fingerprints(texts: list[bytes], shingle: int = 4, seed: int = 42, most: int = 100_000) -> np.ndarray:
    """SimHash of each text: a bit is set if over half of its shingles' XXH64
    have it; texts without words get zero. At most about ``most`` hashes are
    held at a time, so a very long text is summed in stretches."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    total, counts = np.zeros(len(texts), np.int64), np.zeros((len(texts), 64), np.int64)
    hashes, sizes, owners = [], [], []

    def flush() -> None:
        if hashes:
            np.add.at(counts, owners, bit_sums(hashes, sizes))
            for x in (hashes, sizes, owners):
                x.clear()

    for k, b in enumerate(texts):
        words = b.lower().split()
        if not words:
            continue
        n = total[k] = max(1, len(words) - shingle + 1)
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        stops = ends[min(shingle, len(words)) - 1:]
        starts = np.concatenate([[0], ends[:n - 1] + 1])
        for lo in range(0, n, most):
            got = [digest(joined[i:j], seed) for i, j in zip(starts[lo:lo + most].tolist(), stops[lo:lo + most].tolist())]
            hashes += got
            sizes.append(len(got))
            owners.append(k)
            if len(hashes) >= most:
                flush()
    flush()
    bits = ((2 * counts > total[:, None]) & (total[:, None] > 0)).astype(np.uint64)
    return (bits << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)


def words16(fp: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit words."""
    return np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int16)


class Forest:
    """Union by smaller index, with path halving."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def linked(a: np.ndarray, b: np.ndarray, radius: int, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, root) of a spanning forest over all pairs of ``a``
    and ``b`` with at most ``radius`` differing bits; both hold distinct
    values, in any order, and may be the same array."""
    both = np.unique(np.concatenate([a, b]))
    forest = Forest(len(both))
    sides = []
    for x in (a, b):
        c = words16(x)
        order = np.lexsort(c.T[::-1])
        x, c = x[order], c[order]
        cut = np.arange(0, len(x), block)
        sides.append((x, np.searchsorted(both, x), cut, np.minimum.reduceat(c, cut), np.maximum.reduceat(c, cut)))
    (x, xi, xc, xlo, xhi), (y, yi, yc, ylo, yhi) = sides
    for k, lo in enumerate(xc):
        gap = np.maximum(0, np.maximum(ylo - xhi[k], xlo[k] - yhi)).sum(1)
        part = x[lo:lo + block]
        for m in np.flatnonzero(gap <= radius):
            other = y[yc[m]:yc[m] + block]
            i, j = np.nonzero(np.bitwise_count(part[:, None] ^ other[None, :]) <= radius)
            for p, q in zip(xi[lo + i].tolist(), yi[yc[m] + j].tolist()):
                if p != q:
                    forest.join(p, q)
    root = np.fromiter((forest.find(i) for i in range(len(both))), np.int64, len(both))
    off = np.flatnonzero(root != np.arange(len(both)))
    return both[off], both[root[off]]


def near_links(distinct: DataFrame, radius: int, tile: int) -> DataFrame:
    """Edges (a, b) of a spanning forest for each pair of tiles of ``distinct``
    (column fp). Tiles hold about ``tile`` fingerprints; their number for each
    of the 65 population counts comes from an exact count."""
    sized = distinct.withColumn("ones", F.bit_count("fp"))
    number = {r["ones"]: max(1, -(-r["count"] // tile)) for r in sized.groupBy("ones").count().collect()}
    if not number:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    tiles_of = F.create_map(*[F.lit(int(x)) for kv in number.items() for x in kv])
    placed = sized.withColumn("tile", F.pmod(F.xxhash64("fp"), tiles_of[F.col("ones")]).cast("int"))
    packed = materialize(placed.groupBy("ones", "tile").agg(F.collect_list("fp").alias("fps")))
    names = packed.select("ones", "tile")
    right = names.toDF("ones_b", "tile_b")
    near = F.expr(f"explode(sequence(ones, ones + {radius}))")
    pairs = (names.withColumn("ones_b", near).join(right, "ones_b")
             .filter("ones_b > ones or tile_b >= tile"))
    left = packed.toDF("ones", "tile", "x")
    work = (pairs.join(left, ["ones", "tile"]).join(packed.toDF("ones_b", "tile_b", "y"), ["ones_b", "tile_b"])
            .select("ones", "tile", "ones_b", "tile_b", "x", "y")
            .repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                         "ones", "tile", "ones_b", "tile_b").select("x", "y"))

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):
                x, y = (np.asarray(b.column(c)[k].values).astype(np.int64).view(np.uint64) for c in ("x", "y"))
                p, q = linked(x, y, radius)
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(q.view(np.int64))],
                                                     names=["a", "b"])

    return work.mapInArrow(compare, "a long, b long").filter("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for nodes with edges.

    Alternates large-star and small-star until no edge changes; each step is a
    grouping by node and writes its edges to the shared checkpoint folder. A
    node's neighbours are never gathered: both steps need only their minimum."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours point to the smallest of node and neighbours
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # small star: a node and its smaller neighbours point to the smallest neighbour
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = (joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        edges = materialize(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def simhash_groups(docs: DataFrame, shingle: int = 4, radius: int = 4, tile: int = 32768) -> DataFrame:
    """Per row of ``docs``: its key (d, x), doc_id, fp (signed), root (a name of its
    component) and component_id, the smallest doc_id reachable over links of at
    most ``radius`` bits.

    Texts without words, null texts too, have fingerprint zero and are linked
    like any other. Repeated rows give a row each. A null
    doc_id takes part but is no smallest id unless its component has no other."""

    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for part in slices(b, "text"):
                fp = fingerprints(text_bytes(part.column("text")), shingle)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("d"), part.column("x"),
                                                  pa.array(fp.view(np.int64))], names=["doc_id", "d", "x", "fp"])

    key = doc_key("doc_id", "text")
    signed = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                                     key["d"].alias("d"), key["x"].alias("x"))
                         .mapInArrow(sign, "doc_id long, d long, x long, fp long"))
    distinct = materialize(signed.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(near_links(distinct.select("fp"), radius, tile))
    rooted = materialize(distinct.join(roots, distinct["fp"] == roots["node"], "left")
                         .select("fp", "low", F.coalesce("root", "fp").alias("root")))
    others = rooted.filter("root <> fp")
    lowest = others.groupBy("root").agg(F.min("low").alias("least"))
    tops = (rooted.filter("root = fp").select("root", "low").join(lowest, "root", "left")
            .select("root", F.least("low", "least").alias("component_id")))
    # a large component's fingerprints meet their smallest id in SALTS places, not in one task
    salted = others.select("fp", "root", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).alias("salt"))
    shared = (tops.join(lowest, "root", "left_semi")
              .select("root", "component_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")))
    named = materialize(tops.select(F.col("root").alias("fp"), "root", "component_id")
                        .unionByName(salted.join(shared, ["root", "salt"]).select("fp", "root", "component_id")))
    return signed.join(named, "fp").select("doc_id", "d", "x", "fp", "root", "component_id")


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of ``docs`` (struct ``__row``) for each component of ``groups``: that
    of its smallest document key."""
    chosen = groups.groupBy("root").agg(F.min(F.struct("d", "x")).alias("key")).select("key")
    rows = docs.select(F.struct("*").alias(ROW)).withColumn("key", doc_key(f"{ROW}.doc_id", f"{ROW}.text"))
    return rows.join(chosen, "key", "left_semi").dropDuplicates(["key"]).select(ROW)
