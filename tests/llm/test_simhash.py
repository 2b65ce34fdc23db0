import re

import numpy as np
import xxhash

from campaignlab.llm.queries import op7_simhash
from campaignlab.llm.simhash import Forest, components, fingerprints, keep_one, linked, simhash_groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text, k=4):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows, radius=4):
    prints = [brute_print(t) for _, t in rows]
    f = Forest(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                f.join(i, j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = f.find(i)
        low[r] = d if low.get(r) is None else low[r] if d is None else min(low[r], d)
    return [(d, p, low[f.find(i)]) for i, ((d, _), p) in enumerate(zip(rows, prints))]


def test_all_documents(spark, sf001, texts):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op7_simhash(spark, sf001).collect()}
    assert got == {d: (f"{p:016x}", c) for d, p, c in brute_groups(texts)}


def test_long_texts_are_summed_in_stretches(texts):
    some = [t.encode() for _, t in texts[:20]]
    assert (fingerprints(some, most=37) == fingerprints(some)).all()


def test_links_between_any_two_sets():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 63, 40).astype(np.uint64)) ^ np.uint64(5)
    x = np.unique(np.concatenate([base, near, rng.integers(0, 2**63, 300, dtype=np.uint64)]))
    for a, b in ((x, x), (x[::2].copy(), x[1::2].copy())):
        both = np.unique(np.concatenate([a, b]))
        want = Forest(len(both))
        at = {int(v): i for i, v in enumerate(both)}
        for p in a.tolist():
            for q in b.tolist():
                if (p ^ q).bit_count() <= 4:
                    want.join(at[p], at[q])
        p, q = linked(a, b, 4, block=16)
        got = Forest(len(both))
        for i, j in zip(p.tolist(), q.tolist()):
            got.join(at[i], at[j])
        assert [want.find(i) for i in range(len(both))] == [got.find(i) for i in range(len(both))]
        assert len(p) < len(both)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 140), (140, 120), (120, 130)] + [(200 + i, 200) for i in range(1, 50)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(1, 31)} | {i: 100 for i in (120, 130, 140)} | {200 + i: 200 for i in range(1, 50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(make, odd):
    rows = odd + [(20, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (21, "A b c d e f g h i j k l m n o p q r s t u v w x y z")]
    groups = simhash_groups(make(rows))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fp"] % 2**64, r["component_id"]) for r in groups.collect())
    assert got == sorted((d is None, d or 0, p, c) for d, p, c in brute_groups(rows))
    kept = keep_one(make(rows), groups).select("__row.*").collect()
    assert len(kept) == groups.select("root").distinct().count() == 7  # the two texts with id 4 are apart
    assert {r["doc_id"] for r in kept} >= {1, 4, 5, 6, 20} and 21 not in {r["doc_id"] for r in kept}
    assert simhash_groups(make([])).count() == 0
