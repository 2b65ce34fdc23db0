import math
from collections import Counter

from campaignlab.llm.mixing import mix_sources


def test_counts_follow_the_mean_rate(make):
    docs = make([(i, "x" * 10, "hot" if i % 3 else "cold") for i in range(3000)])
    rows = mix_sources(docs, {"hot": 0.2, "cold": 0.8}, epochs=1.0).select("__row.doc_id", "__row.source", "rate", "copy").collect()
    n = Counter(r["source"] for r in rows)
    assert abs(n["hot"] - 600) < 5 * math.sqrt(600) and abs(n["cold"] - 2400) < 5 * math.sqrt(2400)
    per = Counter(r["doc_id"] for r in rows)
    copies = {(r["doc_id"], r["copy"]) for r in rows}
    assert len(copies) == len(rows) and all((d, k) in copies for d, c in per.items() for k in range(1, c + 1))
    cold = Counter(per[i] for i in range(0, 3000, 3))
    for k in range(5):
        want = 1000 * math.exp(-2.4) * 2.4 ** k / math.factorial(k)
        assert abs(cold[k] - want) < 5 * math.sqrt(want)


def test_large_means_are_sums_of_draws(make):
    docs = make([(1, "ab", "a"), *((i, "x" * 500, "b") for i in range(2, 200))])
    rows = mix_sources(docs, {"a": 0.5, "b": 0.5}).filter("__row.source = 'a'").collect()
    rate = rows[0]["rate"]
    assert rate > 20_000 and abs(len(rows) - rate) < 6 * math.sqrt(rate)


def test_odd_rows(make, odd):
    rows = [(d, t, s) for (d, t), s in zip(odd, ["a", "a", "a", None, None, "b", "b", "b", "c", "a"])]
    got = mix_sources(make(rows), {"a": 1.0, "*": 1.0}, epochs=40.0).select("__row.doc_id", "__row.text", "copy").collect()
    same = Counter(r["copy"] for r in got if (r["doc_id"], r["text"]) == (4, "same text here"))
    assert set(same.values()) <= {2}  # repeated rows get the same count each
    assert mix_sources(make([]), {"a": 1.0}).count() == 0
    only = mix_sources(make([(1, None), (2, "")]), {"a": 1.0}).select("rate").distinct().collect()
    assert [r["rate"] for r in only] in ([1.0], [])
    assert {r["rate"] for r in mix_sources(make([(i, "x", "z") for i in range(50)]), {"a": 1.0}).collect()} == {1.0}


def test_order_is_dealt_and_stable(make):
    docs = make([(i, "x", "a") for i in range(400)])
    once = [r["__row"]["doc_id"] for r in mix_sources(docs, {"a": 1.0}).collect()]
    assert once == [r["__row"]["doc_id"] for r in mix_sources(docs, {"a": 1.0}).collect()]
    assert once != sorted(once)


def test_tiny_source_is_dealt_in_chunks(make):
    """A source of one short text with a great share: thousands of copies of one row, the same in chunks."""
    rows = [(1, "ab", "tiny"), (2, "c" * 6000, "src0"), (3, None, "tiny"), (4, "d" * 3000, None)]
    weights = {"tiny": 0.6, "src0": 0.3, "*": 0.1}
    got = {c: mix_sources(make(rows).repartition(2), weights, chunk=c).select("__row.doc_id", "copy") for c in (10**9, 16)}
    whole, chunks = (sorted(map(tuple, d.collect())) for d in got.values())
    assert whole == chunks and sum(d == 1 for d, _ in whole) > 2000
    assert [c for d, c in whole if d == 1] == list(range(1, sum(d == 1 for d, _ in whole) + 1))
    sizes = got[16].rdd.glom().map(len).collect()
    assert max(sizes) < 0.6 * len(whole)
