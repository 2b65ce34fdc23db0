import numpy as np
import re
from collections import Counter

import duckdb

from campaignlab.llm.queries import op2_quality_rules
from campaignlab.llm.quality_rules import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    many = Counter(grams)
    hit = {j for i, g in enumerate(grams) if many[g] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), dup, len(hit),
            n < 10 or 100 * len(hit) > 20 * n)


COLS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_counts_and_verdicts(spark, sf001, texts):
    got = {r["doc_id"]: r for r in op2_quality_rules(spark, sf001).collect()}
    assert len(got) == len(texts)
    for d, t in texts:
        assert tuple(got[d][c] for c in COLS) == brute(t)
        assert got[d]["kept"] == (not got[d]["base_failed"] and got[d]["anomaly"] < got[d]["threshold"])


def test_labelled_rows(spark, sf01):
    marks = dict(duckdb.sql(f"select doc_id, quality from '{sf01}/labels.parquet'").fetchall())
    got = {r["doc_id"]: r["kept"] for r in op2_quality_rules(spark, sf01).collect()}
    good = [got[d] for d, q in marks.items() if q == 1]
    bad = [got[d] for d, q in marks.items() if q == 0]
    assert sum(good) >= 0.97 * len(good)
    assert sum(bad) <= 0.25 * len(bad)


def test_odd_rows(spark, make, odd):
    labels = spark.createDataFrame([(4, 1, 0), (None, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    extra = [(7, "a b c d e f g h i j " * 3), (8, "<b> | " * 20)]
    got = quality_rules(make(odd + extra), labels, trees=8).select("doc_id", *COLS, "kept").collect()
    want = sorted([(d is None, d or 0, *brute(t)) for d, t in odd + extra])
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, *(r[c] for c in COLS)) for r in got) == want
    assert quality_rules(make([]), labels).count() == 0


def test_weights_stand_for_repeated_rows():
    from campaignlab.llm.quality_rules import anomaly, fit_forest

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (400, 3)), [[9.0, 9.0, 9.0]]])
    plain, weighted = fit_forest(x), fit_forest(x, weights=np.append(np.ones(400), 100_000.0))
    assert anomaly(plain, x)[-1] == anomaly(plain, x).max()  # alone it stands out
    assert anomaly(weighted, x)[-1] == anomaly(weighted, x).min()  # as a great group it does not
    same = fit_forest(x, weights=np.ones(401))
    assert np.array_equal(anomaly(same, x), anomaly(plain, x))


def test_many_equal_rows_are_one_row_on_the_driver(spark, make, monkeypatch):
    from campaignlab.llm import quality_rules as q

    seen = []
    fit = q.fit_forest
    monkeypatch.setattr(q, "fit_forest", lambda x, *a, **k: seen.append(len(x)) or fit(x, *a, **k))
    rows = [(None, "the same words again and again in this text of some words")] * 500 + [(i, f"text {i} " * (i % 7 + 5)) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = q.quality_rules(make(rows), labels).collect()
    assert len(got) == 540 and seen[0] <= 41
    assert len({r["anomaly"] for r in got if r["doc_id"] is None}) == 1


def test_each_tree_draws_from_all_rows():
    from campaignlab.llm.quality_rules import race, race_limit

    rng = np.random.default_rng(3)
    names = rng.integers(-2**63, 2**63 - 1, 60_000)
    weights = np.ones(len(names))
    limit = race_limit(len(names), 256)
    row, tree, time = race(names, weights, 24, 256, limit)
    sizes = np.bincount(tree, minlength=24)
    assert sizes.min() >= 256 and sizes.max() < 700  # enough for each tree, and bound
    assert len(np.unique(row)) > 0.9 * len(row)  # trees draw apart
    assert abs(row.mean() / len(names) - 0.5) < 0.02
    cut = [race(names[lo:lo + 7000], weights[lo:lo + 7000], 24, 256, limit) for lo in range(0, len(names), 7000)]
    assert sorted(t for c in cut for t in c[2]) == sorted(time)  # wherever the rows are


def test_copies_arrive_as_single_rows_would():
    from campaignlab.llm.quality_rules import race

    names = np.random.default_rng(4).integers(-2**63, 2**63 - 1, 2001)
    weights = np.append(np.ones(2000), 1000.0)  # a third of all
    row, tree, time = race(names, weights, 60, 128, np.inf)
    order = np.lexsort((time, tree))
    first = np.concatenate([row[order][tree[order] == t][:128] for t in range(60)])
    assert abs((first == 2000).mean() - 1 / 3) < 0.03
    assert (time > 0).all()
