import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from campaignlab.llm.negatives import Residues, hard_negatives, primes_for, products
from campaignlab.llm.topk import SortedLists, top_k
from campaignlab.llm.vectors import blocks_of

# Extra columns whose names the operators also use inside.
SCHEMA = "vec_id long, embedding array<float>, label int, uid long, id string, vec string, block int, asks int, rank int, score long, `a.b` int"
NAN, INF = math.nan, math.inf


@pytest.fixture(scope="module")
def table(spark):
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else 0, 1, "i", "v", 2, 1, 3, 4, 5) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


def whole(vec):
    if vec is None or any(x is None or not math.isfinite(x) for x in vec):
        return None
    return [math.floor(256 * float(np.float32(x))) for x in vec]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def key(i):
    return (i is None, i or 0)


def brute_top(rows, every, k):
    rows = [(r[0], whole(r[1])) for r in rows if whole(r[1]) is not None]
    out = []
    for n, (i, v) in enumerate(rows):
        if i is not None and i % every == 0:
            best = sorted(((-dot(v, w), key(j), m) for m, (j, w) in enumerate(rows) if m != n))[:k]
            out += [(i, r + 1, rows[m][0], -s) for r, (s, _, m) in enumerate(best)]
    return out


def brute_negatives(rows, every, positives, negatives, low, high):
    rows = [(r[0], whole(r[1]), r[2]) for r in rows if whole(r[1]) is not None and r[2] is not None]
    out = []
    for n, (i, v, y) in enumerate(rows):
        if i is None or i % every:
            continue
        score = [dot(v, w) for _, w, _ in rows]
        order = sorted((m for m in range(len(rows)) if m != n), key=lambda m: (-score[m], key(rows[m][0]), m))
        for p in [m for m in order if rows[m][2] == y][:positives]:
            inside = [m for m in order if rows[m][2] != y and low * score[p] <= 100 * score[m] <= high * score[p]]
            out += [(i, rows[p][0], r + 1, rows[m][0], score[p], score[m]) for r, m in enumerate(inside[:negatives])]
    return out


def rows_of(df, cols):
    return sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))


TOP = ("query_id", "rank", "vec_id", "score")
NEG = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def sample(n, seed=0, labels=4):
    g = np.random.default_rng(seed)
    return [(i, g.normal(0, 0.3, 8).astype(np.float32).tolist(), int(g.integers(labels))) for i in range(n)]


ODD = [(0, None, 1), (5, [None, 1.0], 1), (10, [NAN, 1.0], 1), (15, [INF, 0.0], 1), (20, [], 1), (25, [0.5], 1), (30, [0.0, 0.0, 0.0], 2),
       (None, [0.5, 0.5], 1), (None, None, None), (35, [0.5, -0.25, 1.0], None), (40, [0.5, -0.25, 1.0], 1), (40, [0.5, -0.25, 1.0], 1),
       (45, [0.5, -0.25, 1.0], 2), (-50, [0.4, -0.25, 0.9], 2), (7, [0.3, -0.1, 0.9], 2), (8, [0.3, -0.1, 0.9], 1), (9, [30000.0, 1.5, 2.0], 1)]


@pytest.mark.parametrize("rows", [sample(300), ODD, [(0, [1.0] * 3, 0)] * 12, [(5 * i, [0.5, 0.5], i % 2) for i in range(40)], []])
def test_equal_to_brute_force(table, rows):
    got = top_k(table(rows), lambda i: i % 5 == 0, k=4)
    assert rows_of(got, TOP) == sorted(map(repr, brute_top(rows, 5, 4)))
    got = hard_negatives(table(rows), lambda i: i % 5 == 0, positives=3, negatives=4)
    assert rows_of(got, NEG) == sorted(map(repr, brute_negatives(rows, 5, 3, 4, 30, 90)))


def test_many_blocks(table, monkeypatch):
    from campaignlab.llm import negatives, topk

    for m in (topk, negatives):
        monkeypatch.setattr(m, "blocks_of", lambda n: 7)
    rows = sample(400, 3, labels=2) + [(None, [0.1] * 8, 1)] + ODD
    assert rows_of(top_k(table(rows), lambda i: i % 10 == 0), TOP) == sorted(map(repr, brute_top(rows, 10, 5)))
    got = hard_negatives(table(rows), lambda i: i % 10 == 0, positives=3, negatives=4)
    assert rows_of(got, NEG) == sorted(map(repr, brute_negatives(rows, 10, 3, 4, 30, 90)))


def test_components_beyond_32_bits_fail(table):
    with pytest.raises(Exception, match="CAST_OVERFLOW|overflow"):
        top_k(table([(0, [1e30], 1), (1, [1.0], 1)]), lambda i: i % 5 == 0).collect()


def test_blocks():
    assert [blocks_of(n) for n in (0, 1, 2048, 2049, 51282, 16 * 65536, 10**9)] == [1, 1, 1, 2, 16, 16, 15259]


def test_walk_stops_early():
    g = np.random.default_rng(1)
    rows = np.sort((g.pareto(1.5, (20_000, 3)) * 10).astype(np.int64), axis=0)[g.permutation(20_000)]
    lists = SortedLists(rows)
    q = np.array([3, 0, 2])
    best, scores = lists.search(q, 5)
    want = np.lexsort((np.arange(20_000), -(rows @ q)))[:5]
    assert best.tolist() == want.tolist() and scores.tolist() == (rows @ q)[want].tolist()
    assert lists.walked < 1000


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=3, max_size=3), min_size=1, max_size=60),
       st.lists(st.integers(-3, 3), min_size=3, max_size=3), st.integers(1, 6), st.integers(-1, 70))
def test_search_property(rows, q, k, without):
    rows, q = np.array(rows, np.int64), np.array(q, np.int64)
    best, scores = SortedLists(rows).search(q, k, without)
    order = [i for i in np.lexsort((np.arange(len(rows)), -(rows @ q))) if i != without][:k]
    assert best.tolist() == order and scores.tolist() == (rows @ q)[order].tolist()


@pytest.mark.parametrize("width,most", [(64, 200), (64, 2**24), (1, 2**30), (3000, 5000), (5, 1), (0, 1)])
def test_products_are_exact(width, most):
    g = np.random.default_rng(width)
    a, b = g.integers(-most, most + 1, (7, width)), g.integers(-most, most + 1, (9, width))
    if width:
        a[0], b[0], a[1] = most, most, -most
    want = a.astype(object) @ b.astype(object).T if width else np.zeros((7, 9), object)
    got = products(Residues(a), Residues(b))
    assert (got.astype(object) == want).all()
    half = primes_for(width)[0] // 2
    assert min(width, 1024) * half**2 < 2**24


def test_products_out_of_range_fail():
    with pytest.raises(ValueError):
        products(Residues(np.array([[2**31, 2**31]])), Residues(np.array([[2**31, 2**31]])))


def test_queries_on_documents_table(spark, sf001):
    from campaignlab.llm.queries import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{sf001}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert rows_of(queries()["op11_top_k"](spark, sf001), TOP) == sorted(map(repr, brute_top(rows, 50, 5)))
    rows = [(i, v, (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows]
    got = queries()["op12_hard_negatives"](spark, sf001)
    assert rows_of(got, NEG) == sorted(map(repr, brute_negatives(rows, 100, 5, 10, 30, 90)))
