import hashlib
import random
import re

from campaignlab.llm.queries import op9_decontaminate
from campaignlab.llm.wu_manber import WuManber, find_benchmark

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, width=10):
    w, hit, ids = words(text), set(), set()
    for item, s in items:
        s = words(s)
        m = min(width, len(s))
        for i in range(len(w) - m + 1 if m else 0):
            if any(w[i:i + m] == s[j:j + m] for j in range(len(s) - m + 1)):
                hit |= set(range(i, i + m))
                ids |= {str(item)} if item is not None else set()
    return len(w), len(hit), sorted(ids)


def test_search_finds_every_occurrence():
    rng = random.Random(0)
    for _ in range(300):
        text = [rng.choice("abc") for _ in range(rng.randrange(40))]
        m = rng.randrange(1, 7)
        strings = {tuple(rng.choice("abc") for _ in range(m)): [str(i)] for i in range(rng.randrange(1, 6))}
        want = [(i, strings[tuple(text[i:i + m])]) for i in range(len(text) - m + 1) if tuple(text[i:i + m]) in strings]
        assert WuManber(strings).find(text) == want


ITEMS = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short one"), (3, None), (4, "?!"),
         (None, "no id at all"), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "short one"), (10, "naïve 漢字 x1")]
DOCS = [(1, "x Alpha, beta-gamma delta epsilon zeta eta theta iota kappa lambda mu alpha"), (2, "a short one; short one short"),
        (3, "no id at all here"), (4, "beta gamma delta epsilon zeta eta theta iota kappa"), (5, "NAÏVE naïve 漢字 X1!"), (6, "one " * 40_000 + "short one")]


def test_small_fixture(spark, make, odd):
    bench = spark.createDataFrame([(*i, 0) for i in ITEMS], "item_id long, text string, n_words int")
    rows = DOCS + odd
    for block_words in (500_000, 8):  # one block, many blocks
        got = find_benchmark(make(rows), bench, block_words=block_words).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r["n_words"], r["n_hit"], list(r["items"])) == brute(r["__row"]["text"], ITEMS), r
    assert find_benchmark(make([]), bench).count() == 0
    assert {r["n_hit"] for r in find_benchmark(make(rows), bench.limit(0)).collect()} == {0}


def test_test_data(spark, sf001, texts):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf001}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r for r in op9_decontaminate(spark, sf001).collect()}
    grams = {}
    for i, s in items:
        s = words(s)
        for j in range(max(1, len(s) - 9)):
            grams.setdefault(tuple(s[j:j + 10]), set()).add(str(i))
    hits = 0
    for d, t in texts:
        w, hit, ids = words(t), set(), set()
        for i in range(len(w) - 9):
            if tuple(w[i:i + 10]) in grams:
                hit |= set(range(i, i + 10))
                ids |= grams[tuple(w[i:i + 10])]
        r = got[d]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(ids), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        hits += bool(hit)
    assert hits and min(len(words(s)) for _, s in items) >= 10
