import math

import duckdb
import numpy as np
import pytest

from campaignlab.llm.mil import MilModel, byte_classes, encode, encode_long, score_quality, stretches, train_quality
from campaignlab.llm.queries import op6_quality_mil


def test_held_out_accuracy(spark, sf01):
    marks = dict(duckdb.sql(f"select doc_id, quality from '{sf01}/labels.parquet'").fetchall())
    got = op6_quality_mil(spark, sf01).collect()
    held = [(r["predicted"], marks[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in marks]
    assert len(held) > 50 and sum(p == q for p, q in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    m = MilModel(5, hidden=4, gate=3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, bags, y = rng.standard_normal((9, 5)), np.array([2, 4, 3]), np.array([0.0, 1.0, 1.0])

    def loss():
        s = m.forward(x, bags)["score"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    grads = m.gradients(x, bags, y)
    for k, v in m.p.items():
        at = tuple(0 for _ in v.shape)
        old = v[at]
        v[at] = old + 1e-5
        up = loss()
        v[at] = old - 1e-5
        down = loss()
        v[at] = old
        assert abs((up - down) / 2e-5 - grads[k][at]) < 1e-5, k


def test_passages_of_each_text_are_its_own():
    texts = [b"", b"a b c", b"Word, " * 100, "é ü\n".encode() * 60, b"   "]
    x, bags = encode(texts)
    assert bags.tolist() == [1, 1, 3, 3, 1]
    at = 0
    for t, n in zip(texts, bags):
        alone, _ = encode([t])
        assert np.allclose(alone, x[at:at + n], atol=1e-6)
        at += n


def test_odd_rows(spark, make, odd):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (1, 1, 0), (None, 1, 0), (5, None, 0), (4, 0, 0), (99, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    model = train_quality(make(odd), labels)
    got = score_quality(make(odd), model).select("__row.doc_id", "__row.text", "score").collect()
    assert len(got) == len(odd) and all(0 <= r["score"] <= 1 for r in got)
    same = {r["score"] for r in got if r["text"] == "same text here"}
    assert len(same) == 1
    assert len({r["score"] for r in got if not r["text"]}) == 1
    assert score_quality(make([]), model).count() == 0
    none = train_quality(make(odd), labels.limit(0))
    train_quality(make([]), labels)
    assert score_quality(make(odd), none).count() == len(odd)


def test_long_text_neither_ends_nor_leaves_the_sample(spark, make):
    clean = "The house stands by the river and many people walk there. " * 12
    noise = "$$ ## 0101 %% x1 |> " * 40
    rows = [(i, (clean if i % 2 else noise) + f" {i}") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")

    def right(docs):
        got = score_quality(make(rows), train_quality(make(docs), labels)).select("__row.doc_id", "score").collect()
        return sum((r["score"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in got)

    first = spark.sql("select id from range(200) order by xxhash64(id)").first()["id"]
    giant = (clean if first % 2 else noise) * (30_000 if first % 2 else 15_000)  # over 60000 passages, first by hash
    assert right(rows) == 200
    assert right([(first, giant), *(r for r in rows if r[0] != first)]) == 200


def test_parts_of_a_step_add_up():
    rng = np.random.default_rng(2)
    bags = rng.integers(1, 9, 60)
    x, y = rng.standard_normal((bags.sum(), 6)).astype(np.float32), rng.integers(0, 2, 60).astype(np.float32)
    whole, parts = (MilModel(6).fit(x, bags, y, epochs=3, batch=16, part=n) for n in (65_536, 7))
    assert all(np.allclose(whole.p[k], parts.p[k], atol=1e-3) for k in whole.p)
    other = MilModel(6)
    other.unpack(np.frombuffer(whole.pack(), np.float32))
    assert np.array_equal(other.forward(x, bags)["score"], whole.forward(x, bags)["score"])


def plain_features(text):
    """Features of each passage by loops over bytes and words."""
    kind = byte_classes()
    words, at = [], 0
    while at < len(text):  # (start, end) of the words
        if text[at] in b" \t\n\r\x0b\x0c":
            at += 1
            continue
        end = at
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        words.append((at, end))
        at = end
    groups = [words[i:i + 48] for i in range(0, len(words), 48)] or [[]]
    edges = [0, *(g[0][0] for g in groups[1:]), None]
    out = []
    for g, lo, hi in zip(groups, edges, edges[1:]):
        body = (text + b" ")[lo:hi]
        hist = [sum(kind[b] == c for b in body) for c in range(40)]
        chars, n = max(sum(hist[:35]) + hist[38], 1), max(len(g), 1)
        held = [text[a:b] for a, b in g]
        out.append([h / chars for h in hist] + [math.log1p(len(g)), sum(hist[:35]) / n,
                                                sum(x == y for x, y in zip(held, held[1:])) / n, len(set(held)) / n])
    return out


HARD = [b"", b"   ", b"\n\n a\n", b"Word, " * 100, "é ü 漢字\n".encode() * 60, b"a a b B 1 1 $ \t x" * 30, b"one\x00two \xff\xfe three"]


def test_encode_and_forward_equal_plain_loops():
    x, bags = encode(HARD)
    want = [plain_features(t) for t in HARD]
    assert bags.tolist() == [len(w) for w in want]
    assert np.allclose(x, np.concatenate(want), atol=1e-5)
    m = MilModel(44, seed=9)
    m.mean, m.std = x.mean(0), x.std(0) + 0.1
    got = m.forward(x, bags)["score"]
    sig = lambda v: 1 / (1 + math.exp(-v))
    for passages, score in zip(want, got):
        h, power = [], []
        for f in passages:
            z = np.clip((np.array(f) - m.mean) / m.std, -8, 8)
            h.append(np.tanh(z @ m.p["E"] + m.p["e"]))
            v, u = np.tanh(h[-1] @ m.p["V"]), [sig(g) for g in h[-1] @ m.p["U"]]
            power.append(math.exp(float((v * u) @ m.p["a"][:, 0])))
        mean = sum(p * x for p, x in zip(power, h)) / sum(power)
        assert score == pytest.approx(sig(float(mean @ m.p["w"][:, 0] + m.p["b"][0])), abs=1e-4)


def test_long_texts_are_encoded_in_stretches():
    rng = np.random.default_rng(4)
    text = b"".join(rng.choice([b"word ", b"other\n", b"x  ", b"\t", b"1$ ", "é ".encode()], 20_000).tolist())
    for limit in (500, 7_000):
        assert len(stretches(text, limit)) > 3
        for texts in ([text], [b"a", text, b"", text[:300], text[::-1]]):
            (x, bags), (y, more) = encode(texts), encode_long(texts, limit)
            assert bags.tolist() == more.tolist() and np.allclose(x, y, atol=1e-6)
    assert stretches(b"x" * 5000, 500) == [b"x" * 5000] and stretches(b"a\n" * 5000, 500) == [b"a\n" * 5000]


def test_without_labels_every_score_is_one_half(spark, make, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = score_quality(make(odd), train_quality(make(odd), none)).select("score").collect()
    assert {r["score"] for r in got} == {0.5} and len(got) == len(odd)
