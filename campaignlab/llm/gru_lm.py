"""LM scoring by a gated recurrent language model in numpy.

Words outside the model's vocabulary share one symbol; its probability is
divided among them by their smoothed corpus counts, so the model is a proper
distribution over all words. The output softmax is factored into a class and a
word inside its class; classes hold stretches of the frequency order with equal
shares of the square roots of counts. Weights start at the corpus
frequencies and are trained by truncated backpropagation: windows of ``STEPS``
tokens, the state carried from window to window. Shards of the training documents
train on their own and their weights are averaged, each round anew; shards have a
fixed size, so their number grows with the documents.
Scoring carries the state through the whole document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignlab.llm.common import doc_key, materialize, remainder, slices

STEPS = 32
BOUND = 3.0  # of output weights; states are within 1, so exponents stay below 3 * hidden + 20
RARE, END = 0, 1  # symbols before the words of the vocabulary


def sigmoid(x: np.ndarray) -> None:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5


class Window(NamedTuple):
    """``STEPS`` steps of some lanes: input and target symbols, where texts
    start, the document of each step (-1: none), and the lanes' former places."""

    x: np.ndarray
    y: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    lanes: list[int]


def feed(docs: Iterator[tuple[int, np.ndarray]], lanes: int, start: int, ahead: int = 8) -> Iterator[Window]:
    """Deals a stream of documents to lanes: each lane reads on where it stopped
    and takes the next document when one ends, so windows stay full however
    uneven the lengths. Lanes are filled ``ahead`` windows at a time; lanes
    without text are dropped."""
    size = ahead * STEPS
    open_: list = [None] * lanes
    while True:
        n = len(open_)
        x, y = np.zeros((n, size), np.int64), np.zeros((n, size), np.int64)
        first, owner = np.zeros((n, size), bool), np.full((n, size), -1, np.int64)
        for i in range(n):
            t, lane = 0, open_[i]
            while t < size:
                if lane is None:
                    got = next(docs, None)
                    if got is None:
                        break
                    lane = (*got, 0)
                k, doc, at = lane
                m = min(size - t, len(doc) - at)
                y[i, t:t + m] = doc[at:at + m]
                owner[i, t:t + m] = k
                if at:
                    x[i, t:t + m] = doc[at - 1:at + m - 1]
                else:
                    x[i, t], first[i, t] = start, True
                    x[i, t + 1:t + m] = doc[:m - 1]
                lane = (k, doc, at + m) if at + m < len(doc) else None
                t += m
            open_[i] = lane
        alive = np.arange(n)
        for t in range(0, size, STEPS):
            use = np.flatnonzero(owner[alive, t] >= 0)
            if not len(use):
                return
            alive, cut = alive[use], slice(t, t + STEPS)
            yield Window(*(a[alive, cut] for a in (x, y, first, owner)), use.tolist())
        open_ = [open_[i] for i in alive]


class GruModel:
    """``counts``: training counts of the symbols (rare, end, words by falling
    frequency). ``order`` maps a symbol to its place, classes being stretches of places."""

    def __init__(self, counts: np.ndarray, classes: int = 32, hidden: int = 16, seed: int = 11):
        rng = np.random.default_rng(seed)
        counts = np.asarray(counts, float) + 1
        by = np.argsort(-counts, kind="stable")
        mass = np.cumsum(np.sqrt(counts[by]))
        cls = np.minimum((classes * (mass - 0.5 * np.sqrt(counts[by])) / mass[-1]).astype(int), classes - 1)
        cls = np.unique(cls, return_inverse=True)[1]
        self.place = np.empty(len(by), np.int64)
        self.place[by] = np.arange(len(by))
        self.cls = cls.astype(np.uint16)  # two-byte keys are sorted by radix
        self.edge = np.searchsorted(cls, np.arange(cls.max() + 2))
        k, n, h = len(by), cls.max() + 1, hidden
        total = np.add.reduceat(counts[by], self.edge[:-1])
        w = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
        self.p = {"E": (rng.standard_normal((k + 1, h)) * 0.3).astype(np.float32), "W": w(h, 3 * h), "U": w(h, 3 * h),
                  "b": np.zeros(3 * h, np.float32), "C": w(h, n) * 0.1, "c": np.log(total / total.sum()).astype(np.float32),
                  "O": w(k, h) * 0.02, "o": np.log(counts[by] / total[cls]).astype(np.float32)}
        self.hidden, self.start = h, k  # row k of E is read before the first token

    def table(self) -> np.ndarray:
        """What each input symbol adds to the gates."""
        return self.p["E"] @ self.p["W"] + self.p["b"]

    def recur(self, table: np.ndarray, w: Window, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each step of a window; a state is cleared where a text
        starts. ``keep`` receives recurrent inputs, gates and candidates."""
        u, n, lanes = self.p["U"], self.hidden, len(h)
        xw, first = table[w.x.T], w.first.T
        steps = 1 if keep is None else STEPS
        inner = [np.empty((steps, lanes, m), table.dtype) for m in (3 * n, 2 * n, n)]
        out = np.empty((STEPS, lanes, n), table.dtype)
        for t in range(STEPS):
            a, g, c = (x[t % steps] for x in inner)
            if first[t].any():
                h = h * ~first[t][:, None]
            np.matmul(h, u, out=a)
            np.add(xw[t][:, :2 * n], a[:, :2 * n], out=g)
            sigmoid(g)
            np.multiply(g[:, :n], a[:, 2 * n:], out=c)
            c += xw[t][:, 2 * n:]
            np.tanh(c, out=c)
            new = out[t]
            np.subtract(h, c, out=new)
            new *= g[:, n:]
            new += c
            h = new
        if keep is not None:
            keep += inner
        return out

    def outputs(self, h: np.ndarray, y: np.ndarray, grad: dict | None = None) -> np.ndarray:
        """Log probability of places ``y`` after states ``h``; with ``grad`` also
        the gradients of minus their sum, and ``grad['h']``. Rows are brought into
        the order of their classes, so each class is one slice."""
        p = self.p
        by = np.argsort(self.cls[y], kind="stable")
        h, y, rows = h[by], y[by], np.arange(len(y))
        cls = self.cls[y]
        cut = np.searchsorted(cls, np.arange(len(self.edge)))
        z = h @ p["C"]
        z += p["c"]
        logp = z[rows, cls]
        np.exp(z, out=z)  # states and weights are bounded, so this cannot overflow
        s = z @ np.ones(z.shape[1], z.dtype)
        logp -= np.log(s)
        if grad is not None:
            z /= s[:, None]
            z[rows, cls] -= 1
            grad["C"], grad["c"] = h.T @ z, np.ones(len(z), z.dtype) @ z
            dh = z @ p["C"].T
            grad["O"], grad["o"] = np.zeros_like(p["O"]), np.zeros_like(p["o"])
        for k in range(len(self.edge) - 1):
            lo, hi, mine = self.edge[k], self.edge[k + 1], slice(cut[k], cut[k + 1])
            if cut[k] == cut[k + 1] or hi - lo == 1:
                continue
            hk, at = h[mine], (rows[:cut[k + 1] - cut[k]], y[mine] - lo)
            z = hk @ p["O"][lo:hi].T
            z += p["o"][lo:hi]
            logp[mine] += z[at]
            np.exp(z, out=z)
            s = z @ np.ones(hi - lo, z.dtype)
            logp[mine] -= np.log(s)
            if grad is not None:
                z /= s[:, None]
                z[at] -= 1
                grad["O"][lo:hi], grad["o"][lo:hi] = z.T @ hk, np.ones(len(z), z.dtype) @ z
                dh[mine] += z @ p["O"][lo:hi]
        out = np.empty_like(logp)
        out[by] = logp
        if grad is not None:
            grad["h"] = np.empty_like(dh)
            grad["h"][by] = dh
        return out

    def score(self, docs: list[np.ndarray], lanes: int = 512) -> np.ndarray:
        """Natural log probability of each document (arrays of places)."""
        total = np.zeros(len(docs))
        size = [len(d) for d in docs]
        lanes = int(np.clip(sum(size) // max(max(size, default=1), 1), 1, lanes))
        order = sorted(range(len(docs)), key=lambda i: -size[i])  # longest first: lanes end together
        table, h = self.table(), np.zeros((lanes, self.hidden), np.float32)
        for w in feed(((i, docs[i]) for i in order), lanes, self.start):
            states = self.recur(table, w, h[w.lanes])
            h = states[-1]
            t, k = np.nonzero(w.owner.T >= 0)
            total += np.bincount(w.owner[k, t], self.outputs(states[t, k], w.y[k, t]), len(docs))
        return total

    def gradients(self, w: Window, h0: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Of minus the window's log probability; the last states; the loss."""
        p, n, keep = self.p, self.hidden, []
        states = self.recur(self.table(), w, h0, keep)
        t, k = np.nonzero(w.owner.T >= 0)
        g: dict = {}
        loss = -float(self.outputs(states[t, k], w.y[k, t], g).sum())
        out = np.zeros_like(states)
        out[t, k] = g.pop("h")
        rec, gate, c = keep
        clear, back = ~w.first.T[..., None], p["U"].T
        before = np.concatenate([h0[None], states[:-1]]) * clear
        r, u = (np.ascontiguousarray(x) for x in (gate[..., :n], gate[..., n:]))
        # what a state's gradient is worth before the candidate, the update gate and the reset gate
        to_c, to_u, to_r = (1 - u) * (1 - c * c), (before - c) * u * (1 - u), rec[..., 2 * n:] * r * (1 - r)
        u *= clear
        da, dc = np.empty_like(rec), np.empty_like(c)
        dh = np.zeros_like(h0)
        for s in range(STEPS - 1, -1, -1):
            dh = dh + out[s]
            np.multiply(dh, to_c[s], out=dc[s])
            np.multiply(dc[s], to_r[s], out=da[s, :, :n])
            np.multiply(dh, to_u[s], out=da[s, :, n:2 * n])
            np.multiply(dc[s], r[s], out=da[s, :, 2 * n:])
            into = da[s] @ back
            if not clear[s].all():
                into *= clear[s]
            dh *= u[s]
            dh += into
        g["U"] = before.reshape(-1, n).T @ da.reshape(-1, 3 * n)
        da[..., 2 * n:] = dc  # what reaches the gates from the inputs: the candidate is not reset
        flat, symbols = da.reshape(-1, 3 * n), w.x.T.ravel().astype(np.uint16)
        by = np.argsort(symbols, kind="stable")
        first = np.flatnonzero(np.diff(symbols[by], prepend=-1))
        per = np.zeros((len(p["E"]), 3 * n), np.float32)
        per[symbols[by][first]] = np.add.reduceat(flat[by], first)
        g["b"], g["W"], g["E"] = np.ones(len(flat), flat.dtype) @ flat, p["E"].T @ per, per @ p["W"].T
        return g, states[-1], loss

    def train(self, docs: Iterator[np.ndarray], rate: float, lanes: int = 256) -> int:
        """One pass over a stream of documents, Adam steps window by window;
        returns the number of tokens."""
        h, tokens, t = np.zeros((lanes, self.hidden), np.float32), 0, 0
        memory = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        for w in feed(enumerate(docs), lanes, self.start):
            g, h, _ = self.gradients(w, h[w.lanes])
            many = int((w.owner >= 0).sum())
            tokens, t = tokens + many, t + 1
            step = rate * min(1.0, t / 20) * np.sqrt(1 - 0.99 ** t) / (1 - 0.9 ** t)
            for k, d in g.items():
                m, s = memory[k]
                d = np.clip(d / many, -1, 1)
                m += 0.1 * (d - m)
                s += 0.01 * (d * d - s)
                self.p[k] = self.p[k] - (step * m / (np.sqrt(s) + 1e-5)).astype(self.p[k].dtype)
            for k in ("C", "O"):
                np.clip(self.p[k], -BOUND, BOUND, out=self.p[k])
        return tokens

    def pack(self) -> bytes:
        return np.concatenate([v.ravel() for v in self.p.values()]).astype(np.float32).tobytes()

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at:at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size


def words_in(texts):
    """Words of all texts (an Arrow string array), lower-cased by A-Z, and the text of each."""
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, doc = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty string
    return words.filter(full), doc.filter(full).to_numpy()


def ranked(texts, top) -> tuple:
    """Per token the place of its word in ``top``, len(top) for other words and one
    more for the end that closes each text; tokens per text; and of the words: their text,
    their code, and the dictionary of codes."""
    import pyarrow.compute as pc

    words, doc = words_in(texts)
    coded = words.dictionary_encode()
    rank = pc.fill_null(pc.index_in(coded.dictionary, value_set=top), len(top)).to_numpy()
    codes = coded.indices.to_numpy()
    size = np.bincount(doc, minlength=len(texts)) + 1
    at = np.full(size.sum(), len(top) + 1, np.int32)
    inner = np.ones(len(at), bool)
    inner[np.cumsum(size) - 1] = False
    at[inner] = rank[codes]
    return at, size, doc, codes, coded.dictionary


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over whole texts; word '' is the end of a text."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        parts, held, ends = [], 0, 0

        def added():
            return pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])

        for b in batches:
            for part in slices(b, "text", 8_000_000):
                got = words_in(part.column("text"))[0].value_counts()
                parts.append(pa.table({"word": got.field("values"), "c": got.field("counts")}))
                held, ends = held + len(got), ends + len(part)
                if held > 1_500_000:
                    parts = [added()]
                    held = len(parts[0])
                if held > 1_000_000:  # one table by now
                    yield from parts[0].combine_chunks().to_batches()
                    parts, held = [], 0
        if ends:
            parts.append(pa.table({"word": pa.array([""]), "c": pa.array([ends], pa.int64())}))
            yield from added().combine_chunks().to_batches()

    text = F.col("text").cast("string").alias("text")
    return docs.select(text).mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """At most ``most`` words with the highest counts, in falling order. A
    histogram of counts (exact up to 256, then eight bins an octave) gives the
    bound, so that no more than these words ever leave the executors."""
    c = F.col("c")
    level = F.when(c <= 256, c).otherwise(256 + F.floor(8 * (F.log2(c) - 8)) + 1).cast("int")
    named = counts.filter("word <> ''").withColumn("level", level)
    held, least = 0, None
    for r in sorted(named.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        held += r["count"]
        if held > most:
            break
        least = r["level"]
    if least is None:
        return []
    rows = named.filter(F.col("level") >= least).select("word", "c").collect()
    return sorted(((r["word"].encode(), r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))


def train_model(docs: DataFrame, model: GruModel, symbols: dict[bytes, int], tokens: int, shard_tokens: int,
                rounds: int, rate: float) -> GruModel:
    """All documents train, each in one round and shard by its key. Shards hold about
    ``shard_tokens`` tokens, so their number grows with the ``tokens`` and no task's work does.
    Weights are averaged in tasks first: the driver adds up about the square root of
    the number of partitions in vectors of fixed size."""
    import pyarrow as pa

    shards = max(1, -(-tokens // (shard_tokens * rounds)))
    parts = min(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = docs.select(doc_key("doc_id", "text").alias("k"), "text")
    # rows that repeat a document go to a shard for each part of the input, not all to one
    keyed = keyed.withColumn("shard", F.pmod(F.xxhash64("k", F.spark_partition_id()), F.lit(shards * rounds)).cast("int"))
    known = pa.array([w.decode() for w in symbols], pa.string())
    place = model.place[[*symbols.values(), RARE, END]].astype("<u2")

    def name(batches: Iterator) -> Iterator:
        for b in batches:
            for part in slices(b, "text", 8_000_000):
                at, size, *_ = ranked(part.column("text"), known)
                ends = np.concatenate([[0], np.cumsum(2 * size)]).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(place[at])])
                yield pa.RecordBatch.from_arrays([part.column("shard"), part.column("h"), ids], names=["shard", "h", "ids"])

    named = (keyed.select("shard", F.xxhash64("k.x").alias("h"), "text").mapInArrow(name, "shard int, h long, ids binary"))
    named = materialize(named) if rounds > 1 else named

    def summed(pairs: Iterator[tuple[int, np.ndarray]]) -> Iterator:
        """One row: the tokens and the sum of the weights."""
        many, total = 0, 0.0
        for n, weights in pairs:
            many, total = many + n, total + weights
        if many:
            yield pa.RecordBatch.from_arrays([pa.array([many], pa.int64()), pa.array([total.tobytes()], pa.binary())],
                                             names=["tokens", "weights"])

    def fit(batches: Iterator) -> Iterator:
        import copy

        def trained() -> Iterator[tuple[int, np.ndarray]]:
            rows = ((shard, ids) for b in batches
                    for shard, ids in zip(b.column("shard").to_pylist(), b.column("ids").to_pylist()))
            for _, mine in groupby(rows, key=lambda r: r[0]):
                own = copy.deepcopy(model)
                n = own.train((np.frombuffer(ids, "<u2").astype(np.int64) for _, ids in mine), rate)
                yield n, np.frombuffer(own.pack(), np.float32).astype(float) * n

        return summed(trained())

    def add(batches: Iterator) -> Iterator:
        return summed((n, np.frombuffer(w, float)) for b in batches
                      for n, w in zip(b.column("tokens").to_pylist(), b.column("weights").to_pylist()))

    for r in range(rounds):
        mine = named.filter((F.col("shard") >= r * shards) & (F.col("shard") < (r + 1) * shards))
        sums = (mine.repartitionById(parts, F.pmod("shard", F.lit(parts)))
                .sortWithinPartitions("shard", F.length("ids") < 8192, "h", "ids")  # no lane is left with a long text
                .mapInArrow(fit, "tokens long, weights binary"))
        got = (sums.repartition(math.isqrt(parts), F.xxhash64("weights")).sortWithinPartitions("tokens", "weights")
               .mapInArrow(add, "tokens long, weights binary").collect())
        got.sort(key=lambda x: (x["tokens"], bytes(x["weights"])))
        seen = sum(x["tokens"] for x in got)
        if seen:
            model.unpack(sum(np.frombuffer(bytes(x["weights"]), float) for x in got) / seen)
    return model


def lm_scores(docs: DataFrame, vocabulary: int = 2046, frequent: int = 262_144, shard_tokens: int = 2_000_000,
              rounds: int = 2, rate: float = 0.01, modulus: int = 7, held: int = 2) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (log10).

    Learns from rows whose crc32(doc_id as text) mod ``modulus`` is not
    ``held``: counts and the network cover all of them, whole texts, the network in
    shards of about ``shard_tokens`` tokens. Null and empty texts are the end token
    alone; a null id counts as empty text in the fold; repeated rows count each and
    score alike; an empty training fold gives base probabilities of one. The driver
    sees the ``frequent`` most frequent words and sums of weights; counts of all
    other words meet the documents in a join by word."""
    import pyarrow as pa

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("held_out", remainder("doc_id", modulus) == held)
    train = rows.filter(~F.col("held_out"))
    counts = materialize(word_counts(train))
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = int(total["n"] or 0), int(total["v"])
    top = frequent_words(counts, frequent)
    ends = int(counts.filter("word = ''").agg(F.sum("c")).first()[0] or 0)
    known = dict(top[:vocabulary])
    symbols = {w: k + 2 for k, w in enumerate(known)}
    rare_n = n - ends - sum(known.values())
    rare_v = max(v - len(known) - (1 if ends else 0), 0)
    model = GruModel(np.array([rare_n, ends, *known.values()], float))
    model = train_model(train, model, symbols, n, shard_tokens, rounds, rate)
    words_ranked = pa.array([w.decode() for w, _ in top], pa.string())
    # tables by rank; then words that are not frequent, then the end of a text
    many = len(top)
    own, frequent_ = np.arange(many + 2) < len(known), np.arange(many + 2) < many
    places = model.place[np.where(own, np.arange(many + 2) + 2, RARE)].astype(np.int32)
    places[-1] = model.place[END]
    logs = np.log10(np.array([*(c for _, c in top), 0, ends], float) + 1)
    inner = np.where(own, 0.0, logs)
    inner[-1] = 0.0
    is_known, is_rare = frequent_.astype(np.int8), (frequent_ & ~own).astype(np.int8)
    is_known[-1] = ends > 0

    def scan(batches: Iterator) -> Iterator:
        names = ["uid", "doc_id", "held_out", "word", "n", "n_tokens", "n_known", "base", "inner", "n_rare", "gru"]
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(),
                 pa.float64(), pa.int64(), pa.float64())

        def frame(cols: list, n: int):
            arrays = [pa.nulls(n, k) if c is None else c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for b in batches:
            for part in slices(b, "text", 8_000_000):
                uid = part.column("uid").to_numpy()
                at, size, doc, codes, words = ranked(part.column("text"), words_ranked)
                first = np.cumsum(size) - size
                gru = model.score(np.split(places[at], first[1:])) / np.log(10)
                whole = lambda table, kind: np.add.reduceat(table[at], first, dtype=kind)
                mark = [f" {i}" for i in uid.tolist()]
                yield frame([uid, part.column("doc_id"), part.column("held_out"), mark, np.zeros(len(uid), np.int64), size,
                             whole(is_known, np.int64), whole(logs, float), whole(inner, float), whole(is_rare, np.int64), gru],
                            len(uid))
                at = at[at != many + 1] == many  # the words that are not frequent
                seldom, times = np.unique(doc[at].astype(np.int64) * len(words) + codes[at], return_counts=True)
                for i in range(0, len(seldom), 100_000):
                    of, word = np.divmod(seldom[i:i + 100_000], len(words))
                    n, many_times = len(of), times[i:i + 100_000]
                    yield frame([uid[of], None, None, words.take(pa.array(word)), many_times, np.zeros(n, np.int64),
                                 np.zeros(n, np.int64), np.zeros(n), np.zeros(n), many_times, np.zeros(n)], n)

    keyed = rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "held_out", "text")
    seen = keyed.mapInArrow(scan, "uid long, doc_id long, held_out boolean, word string, n long, n_tokens long, "
                                  "n_known long, base double, inner double, n_rare long, gru double")
    # a document's own row carries a word no text can hold, so it meets no count and no other document
    met = seen.join(counts, "word", "left")
    log = F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)
    per = (met.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0))).alias("n_known"),
        (F.sum("base") + F.sum(log)).alias("base"), (F.sum("inner") + F.sum(log)).alias("inner"),
        F.sum("n_rare").alias("n_rare"), F.sum("gru").alias("gru")))
    whole = float(np.log10(n + v + 1.0))
    rare = float(np.log10(rare_n + rare_v + 1.0))
    return per.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
                      (F.col("base") - F.col("n_tokens") * whole).alias("base_score"),
                      (F.col("gru") + F.col("inner") - F.col("n_rare") * rare).alias("score"))
