import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from campaignlab.llm import gru_lm
from campaignlab.llm.gru_lm import GruModel, feed, lm_scores
from campaignlab.llm.queries import op8_gru_lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [""]


def held(d):
    return zlib.crc32(str(d).encode() if d is not None else b"") % 7 == 2


def base(rows):
    c = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(d, held(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n,
             sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for d, t in rows]


def test_base_and_model_on_held_out(spark, sf01):
    got = {r["doc_id"]: r for r in op8_gru_lm(spark, sf01).collect()}
    texts = spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id", "text").collect()
    for d, h, n, k, total, score in base(texts):
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, n, k, total)
        assert r["base_score"] == pytest.approx(score, rel=1e-9)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_model_is_a_distribution_and_carries_state():
    rng = np.random.default_rng(1)
    m = GruModel(rng.integers(1, 1000, 60), classes=7, hidden=8)
    m.train(iter([rng.integers(0, 60, n) for n in (5, 70, 130)]), 0.05, lanes=2)
    head = rng.integers(0, 60, 45)  # longer than a window
    every = m.score([np.append(head, k) for k in range(60)]) - m.score([head])[0]
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-4)
    docs = [rng.integers(0, 60, n) for n in (1, 32, 33, 100, 64)]
    assert np.allclose(m.score(docs), [m.score([d])[0] for d in docs], atol=1e-3)


def test_gradients_match_differences():
    rng = np.random.default_rng(4)
    m = GruModel(rng.integers(1, 50, 12), classes=3, hidden=4)
    m.p = {k: v.astype(np.float64) + 0.1 * rng.standard_normal(v.shape) for k, v in m.p.items()}
    docs = [rng.integers(0, 12, n) for n in (20, 9, 40, 3)]
    w = next(feed(enumerate(docs), 2, m.start, ahead=1))
    h0 = rng.standard_normal((2, 4)).astype(np.float32)
    m.recur = lambda *a, f=m.recur: f(*a).astype(np.float64)
    grads, _, _ = m.gradients(w, h0)
    for k, v in m.p.items():
        at = np.unravel_index(np.argmax(np.abs(grads[k])), v.shape)
        old, both = v[at], []
        for d in (1e-2, -1e-2):
            v[at] = old + d
            both.append(m.gradients(w, h0)[2])
        v[at] = old
        assert (both[0] - both[1]) / 2e-2 == pytest.approx(grads[k][at], rel=0.03, abs=0.02), k


def test_training_helps():
    rng = np.random.default_rng(3)
    docs = [np.tile([2, 3, 4, 5], 20 + rng.integers(0, 5)) for _ in range(40)]
    m = GruModel([1, 40, *[800] * 4], classes=3, hidden=8)
    before = m.score(docs).sum()
    m.train(iter(docs * 40), 0.02, lanes=8)
    assert m.score(docs).sum() > 0.3 * before


def test_odd_rows(make, odd):
    got = lm_scores(make(odd), vocabulary=5, frequent=7, shard_tokens=20, rounds=1).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(base(odd), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])
    assert all(g[6] <= 0 for g in got)
    assert lm_scores(make([])).count() == 0
    alone = lm_scores(make([(d, "a b") for d in range(200) if held(d)])).collect()
    assert alone and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in alone)


def test_average_does_not_depend_on_the_number_of_partitions(spark, make):
    docs = make([(i, " ".join(f"w{(i * k) % 9}" for k in range(1, 12))) for i in range(40)])
    got, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 4, 9):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            rows = lm_scores(docs, vocabulary=6, shard_tokens=30, rounds=2).collect()
            got.append({r.doc_id: r.score for r in rows})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for other in got[1:]:
        assert all(abs(other[k] - v) < 1e-3 for k, v in got[0].items())


def test_network_has_its_whole_size(make, monkeypatch):
    seen = []

    def look(docs, model, symbols, *rest):
        seen.append((len(symbols), model.hidden, len(model.edge) - 1))
        return model

    monkeypatch.setattr(gru_lm, "train_model", look)
    text = " ".join(f"w{i}" for i in range(3000))
    assert lm_scores(make([(d, text) for d in range(8) if not held(d)])).count()
    assert seen == [(2046, 16, 32)]


def test_score_equals_a_plain_loop():
    rng = np.random.default_rng(8)
    m = GruModel(rng.integers(1, 300, 40), classes=6, hidden=5)
    m.train(iter([rng.integers(0, 40, n) for n in (50, 90)]), 0.05, lanes=2)
    p, n = m.p, m.hidden
    sig = lambda v: 1 / (1 + np.exp(-v))
    norm = lambda v: v - math.log(np.exp(v).sum())
    docs = [rng.integers(0, 40, k) for k in (1, 31, 32, 33, 80)]
    for doc, got in zip(docs, m.score(docs)):
        h, before, total = np.zeros(n), m.start, 0.0
        for y in doc:
            x, u = p["E"][before] @ p["W"] + p["b"], h @ p["U"]
            reset, update = sig(x[:n] + u[:n]), sig(x[n:2 * n] + u[n:2 * n])
            h = update * h + (1 - update) * np.tanh(x[2 * n:] + reset * u[2 * n:])
            c = m.cls[y]
            lo, hi = m.edge[c], m.edge[c + 1]
            total += norm(h @ p["C"] + p["c"])[c] + norm(p["O"][lo:hi] @ h + p["o"][lo:hi])[y - lo]
            before = y
        assert got == pytest.approx(total, abs=1e-2)


def test_many_equal_rows(make):
    rows = [(None, "a b a c")] * 300 + [(i, "a d") for i in range(30)]
    got = lm_scores(make(rows), vocabulary=3, frequent=3, shard_tokens=50).collect()
    assert len(got) == 330
    same = [r for r in got if r["doc_id"] is None]
    assert len(same) == 300 and len({(r["n_tokens"], r["n_known"], round(r["base_score"], 9)) for r in same}) == 1
