"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded
from its shares of character classes, word lengths and repetition; gated
attention (tanh and sigmoid branches) weighs the passages, and the weighted
mean representation is scored. Weights come from document labels only, by Adam
on whole texts of a sample of labelled rows; all documents are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignlab.llm.common import ROW, cuts, hashed_share, slices, text_bytes

PASSAGE = 48
CLASSES = 40


def byte_classes() -> np.ndarray:
    """Class of each byte: small, capital, digit, each ASCII sign, new line,
    other white space, other control, first and later bytes beyond ASCII."""
    out = np.full(256, 36)
    signs = iter(range(3, 35))
    for b in range(33, 127):
        c = chr(b)
        out[b] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else next(signs)
    out[10], out[128:192], out[192:] = 35, 37, 38
    out[[9, 11, 12, 13, 32]] = 39
    return out


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages and the number of passages of each text (an
    empty text has one passage of zeros)."""
    n = len(texts)
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, n)
    doc = np.repeat(np.arange(n), size)
    kind = byte_classes().astype(np.int64)[data]
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    start = ~blank
    start[1:] &= blank[:-1]  # texts are joined by a space, so a word never crosses two
    words = np.bincount(doc[start], minlength=n)
    passages = np.maximum(1, -(-words // PASSAGE))
    base = np.cumsum(passages) - passages
    order = np.cumsum(start) - 1 - np.repeat(np.cumsum(words) - words, size)
    of = np.repeat(base, size) + np.clip(order, 0, None) // PASSAGE
    of = np.minimum(of, np.repeat(base + passages - 1, size))
    total = int(passages.sum())
    hist = np.bincount(of * CLASSES + kind, minlength=total * CLASSES).reshape(total, CLASSES).astype(np.float32)
    at = np.flatnonzero(start)
    chars = np.maximum(hist[:, :35].sum(1) + hist[:, 38], 1)[:, None]
    extra = np.zeros((total, 4), np.float32)
    if len(at):
        inside = np.where(blank, 0, data.astype(np.uint64) + np.uint64(1))
        place = (np.arange(len(data)) - at[np.clip(np.cumsum(start) - 1, 0, None)]).astype(np.uint64)
        mixed = inside * ((place * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD6E8FEB86659FD93))
        name = np.add.reduceat(mixed, at)
        p = of[at]
        count = np.bincount(p, minlength=total)
        same = np.zeros(len(at), bool)
        same[1:] = (name[1:] == name[:-1]) & (p[1:] == p[:-1])
        order = np.lexsort((name, p))
        fresh = np.ones(len(at), bool)
        fresh[1:] = (name[order][1:] != name[order][:-1]) | (p[order][1:] != p[order][:-1])
        k = np.maximum(count, 1)
        extra[:, 0] = np.log1p(count)
        extra[:, 1] = hist[:, :35].sum(1) / k
        extra[:, 2] = np.bincount(p[same], minlength=total) / k
        extra[:, 3] = np.bincount(p[order][fresh], minlength=total) / k
    return np.concatenate([hist / chars, extra], 1).astype(np.float32), passages


def stretches(text: bytes, limit: int) -> list[bytes]:
    """A long text in parts of about ``limit`` bytes that hold whole passages: cut before
    the first word of a passage and after a space or the like, which ``encode`` puts back."""
    out, start, words, at = [], 0, 0, 0
    blank_end = True  # the byte before is white space
    while at < len(text) and len(text) - start > limit:
        data = np.frombuffer(text[at:at + limit], np.uint8)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        before = np.concatenate([[blank_end], blank[:-1]])
        begin = np.flatnonzero(~blank & before)
        number = words + np.arange(len(begin))
        for p in (at + begin[number % PASSAGE == 0]).tolist():
            if p - start >= limit and p and text[p - 1] in b" \t\x0b\x0c\r":
                out.append(text[start:p - 1])
                start = p
        words, blank_end, at = words + len(begin), bool(blank[-1]), at + limit
    return [*out, text[start:]]


def encode_long(texts: list[bytes], limit: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """``encode``, with the working arrays bound by ``limit`` bytes however long a text is."""
    parts = [stretches(t, limit) if len(t) > limit else [t] for t in texts]
    flat = [p for ps in parts for p in ps]
    got = [encode(flat[lo:hi]) for lo, hi in cuts([len(p) for p in flat], limit)]
    if not got:
        return encode([])
    bags = np.concatenate([b for _, b in got])
    return np.concatenate([x for x, _ in got]), np.add.reduceat(bags, np.cumsum([0, *map(len, parts)])[:-1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class MilModel:
    """Gated-attention network in numpy: ``p`` holds its weights."""

    def __init__(self, inputs: int, hidden: int = 24, gate: int = 12, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.trained = False
        w = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.mean, self.std = np.zeros(inputs, np.float32), np.ones(inputs, np.float32)
        self.p = {"E": w(inputs, hidden), "e": np.zeros(hidden, np.float32), "V": w(hidden, gate), "U": w(hidden, gate),
                  "a": w(gate, 1), "w": w(hidden, 1), "b": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        p, first = self.p, np.cumsum(bags) - bags
        x = np.clip((x - self.mean) / self.std, -8, 8)
        h = np.tanh(x @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        s = ((v * u) @ p["a"])[:, 0]
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, first), bags))
        weight = s / np.repeat(np.add.reduceat(s, first), bags)
        z = np.add.reduceat(h * weight[:, None], first)
        return {"x": x, "h": h, "v": v, "u": u, "weight": weight, "z": z, "score": sigmoid(z @ p["w"] + p["b"])[:, 0]}

    def gradients(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, bags)
        first, bag = np.cumsum(bags) - bags, np.repeat(np.arange(len(bags)), bags)
        d = ((f["score"] - y) / len(y)).astype(np.float32)[:, None]
        dz = (d @ p["w"].T)[bag]
        dh = dz * f["weight"][:, None]
        dw = (dz * f["h"]).sum(1)
        ds = (f["weight"] * (dw - np.add.reduceat(f["weight"] * dw, first)[bag]))[:, None]
        dvu = ds @ p["a"].T
        dv, du = dvu * f["u"] * (1 - f["v"] ** 2), dvu * f["v"] * f["u"] * (1 - f["u"])
        dh += dv @ p["V"].T + du @ p["U"].T
        dx = dh * (1 - f["h"] ** 2)
        return {"E": f["x"].T @ dx, "e": dx.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "a": (f["v"] * f["u"]).T @ ds,
                "w": f["z"].T @ d, "b": d.sum(0)}

    def fit(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.01,
            seed: int = 5, part: int = 65_536) -> MilModel:
        """``x`` may lie on disk: about ``part`` passages of it are read at a time, a
        bag always whole; a step adds up the gradients of its parts."""
        rng = np.random.default_rng(seed)
        total, square = np.zeros((2, x.shape[1]))
        for lo in range(0, len(x), part):
            some = x[lo:lo + part].astype(float)
            total, square = total + some.sum(0), square + (some * some).sum(0)
        mean = total / len(x)
        self.mean = mean.astype(np.float32)
        self.std = np.sqrt(np.maximum(square / len(x) - mean * mean, 0)).astype(np.float32) + np.float32(1e-3)
        first = np.cumsum(bags) - bags
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for lo in range(0, len(order), batch):
                pick = order[lo:lo + batch]
                t += 1
                sums = {k: 1e-5 * v for k, v in self.p.items()}
                for a, b in cuts(bags[pick], part):
                    mine = pick[a:b]
                    size = bags[mine]
                    rows = np.repeat(first[mine] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    for k, g in self.gradients(np.asarray(x[rows]), size, y[mine]).items():
                        sums[k] = sums[k] + g * np.float32(len(mine) / len(pick))
                for k, g in sums.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.99 * s[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - rate * m[k] / (1 - 0.9 ** t)
                                 / (np.sqrt(s[k] / (1 - 0.99 ** t)) + 1e-6)).astype(np.float32)
        return self

    def pack(self) -> bytes:
        return np.concatenate([v.ravel() for v in (self.mean, self.std, *self.p.values())]).astype(np.float32).tobytes()

    def unpack(self, flat: np.ndarray) -> None:
        n = len(self.mean)
        self.mean, self.std, at = flat[:n].copy(), flat[n:2 * n].copy(), 2 * n
        for k, v in self.p.items():
            self.p[k] = flat[at:at + v.size].reshape(v.shape).copy()
            at += v.size


def train_quality(docs: DataFrame, labels: DataFrame, max_docs: int = 4000) -> MilModel:
    """Fits on about ``max_docs`` rows (doc_id, quality) of ``labels`` taken by hash
    and the whole texts of ``docs`` with their ids, however long. One task trains:
    it keeps the passages in a file of its own and reads them batch by batch; the
    driver gets the weights. Of rows that repeat an id the smallest text and label
    count. Without any labelled document the model stays untrained (``trained``)."""
    model = MilModel(CLASSES + 4)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    marks = marks.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marks = hashed_share(marks, max_docs, "doc_id")  # about max_docs rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    picked = (texts.join(F.broadcast(marks), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
              .select("text", "quality", F.xxhash64("doc_id").alias("h")))

    def passages(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for part in slices(b, "text", 1_500_000):
                x, bags = encode_long(text_bytes(part.column("text")))
                ends = np.cumsum(bags)
                yield pa.RecordBatch.from_arrays(
                    [part.column("quality"), part.column("h"),
                     pa.array([x[e - n:e].tobytes() for e, n in zip(ends, bags)], pa.binary())], names=["quality", "h", "x"])

    def fit(batches: Iterator) -> Iterator:
        from tempfile import TemporaryFile

        import pyarrow as pa

        bags, y, width = [], [], 4 * (CLASSES + 4)
        with TemporaryFile() as file:
            for b in batches:
                for quality, x in zip(b.column("quality").to_pylist(), b.column("x")):
                    bags.append(file.write(x.as_buffer()) // width)
                    y.append(quality)
            if bags:
                file.flush()
                x = np.memmap(file, np.float32, "r", shape=(sum(bags), CLASSES + 4))
                model.fit(x, np.array(bags, np.int64), np.array(y, np.float32))
                yield pa.RecordBatch.from_arrays([pa.array([model.pack()], pa.binary())], names=["weights"])

    got = (picked.mapInArrow(passages, "quality int, h long, x binary").repartition(1).sortWithinPartitions("h", "quality")
           .mapInArrow(fit, "weights binary").collect())
    if got:
        model.unpack(np.frombuffer(bytes(got[0]["weights"]), np.float32))
        model.trained = True
    return model


def score_quality(docs: DataFrame, model: MilModel) -> DataFrame:
    """Struct ``__row`` and ``score`` for each row of ``docs``: the chance of good
    quality. Null and empty texts are scored as one empty passage; repeated
    rows alike; an empty table gives an empty result; extra columns stay in the
    struct. Nothing but the text enters a score. An untrained model knows nothing
    and gives every text 0.5."""
    rows = docs.select(F.struct("*").alias(ROW))
    if not model.trained:
        return rows.withColumn("score", F.lit(0.5))

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = [model.forward(*encode_long([t.encode() for t in part.iloc[lo:hi]]))["score"]
                   for lo, hi in cuts(part.map(len).to_numpy(), 1_000_000)]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0), dtype=float)

    return rows.withColumn("score", scored(F.coalesce(F.col(f"{ROW}.text").cast("string"), F.lit(""))))
