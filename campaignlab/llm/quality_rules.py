"""Quality rules: an isolation forest over rule statistics.

One pass computes the statistics of every document. Each tree of the forest draws
its own ``psi`` rows from the statistics of all documents (the method's
subsampling); documents that random splits isolate early are anomalous. The threshold on the anomaly score is calibrated on all
labelled rows from a histogram of scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignlab.llm.common import cuts, materialize, slices, text_bytes

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
PUNCT = b"!?.,;:"
SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits",
          "n_punct", "n_distinct", "n_bare")
BINS = 2000


def repeated_words(ids: list[np.ndarray], width: int = 5) -> np.ndarray:
    """Per document: words inside ``width``-word windows that its text holds
    twice or more. Windows are compared exactly: names of windows are doubled
    in length by ranking pairs of names."""
    out = np.zeros(len(ids), np.int64)
    lens = np.array([len(x) for x in ids], np.int64)
    use = np.flatnonzero(lens > width)
    if not len(use):
        return out
    flat = np.concatenate([ids[i] for i in use]).astype(np.int64)
    size = lens[use]
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    doc = np.repeat(np.arange(len(use)), size)
    pos = np.arange(len(flat)) - np.repeat(first, size)
    at = np.flatnonzero(pos <= np.repeat(size, size) - width)
    name = doc[at]
    for k in range(width):
        pair = name * (flat.max() + 1) + flat[at + k]
        name = np.unique(pair, return_inverse=True)[1]
    again = np.bincount(name)[name] > 1
    edge = np.zeros(len(flat) + 1, np.int64)
    edge[at[again]] += 1
    np.subtract.at(edge, at[again] + width, 1)
    covered = np.cumsum(edge[:-1]) > 0
    out[use] = np.add.reduceat(covered.astype(np.int64), first)
    return out


def statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts in ``COUNTS`` for each text."""
    rows, ids, names = [], [], {}
    for b in texts:
        words = b.split()
        ids.append(np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words)))
        solid = b.translate(None, SPACE)
        seen, dup, lines = set(), 0, 0
        for line in b.split(b"\n"):
            if line.strip():
                lines += 1
                dup += line in seen
                seen.add(line)
        rows.append((len(words), len(solid.decode("utf-8", "replace")), len(solid) - len(solid.translate(None, SYMBOLS)),
                     dup, 0, lines, len(solid) - len(solid.translate(None, UPPER)),
                     len(solid) - len(solid.translate(None, DIGITS)), len(solid) - len(solid.translate(None, PUNCT)),
                     len(set(words)), sum([len(w) < 4 and not w.strip(SIGNS) for w in words])))
    table = np.array(rows, np.int64).reshape(len(rows), len(COUNTS))
    table[:, COUNTS.index("n_repeat_words")] = repeated_words(ids)
    return {c: table[:, i] for i, c in enumerate(COUNTS)}


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """Word length; symbols by character and by word; words without a letter or
    digit; capitals; punctuation by word; words in repeated windows; distinct words."""
    words = np.maximum(c["n_words"], 1)
    chars = np.maximum(c["word_chars"], 1)
    return np.stack([c["word_chars"] / words, c["n_symbols"] / chars, c["n_symbols"] / words, c["n_bare"] / words,
                     c["n_upper"] / chars, c["n_punct"] / words, c["n_repeat_words"] / words,
                     c["n_distinct"] / words ** 0.8], 1)


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, float)
    h = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator, depth: int) -> list[tuple]:
    """Nodes (feature, split, left, right, path): feature -1 marks a leaf."""
    nodes: list = []

    def add(rows: np.ndarray, level: int) -> int:
        me = len(nodes)
        nodes.append(None)
        spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 else ()
        if level >= depth or not len(spread):
            nodes[me] = (-1, 0.0, me, me, level + float(average_path(len(rows))))
            return me
        f = int(rng.choice(spread))
        at = rng.uniform(rows[:, f].min(), rows[:, f].max())
        low = rows[:, f] <= at
        nodes[me] = (f, at, add(rows[low], level + 1), add(rows[~low], level + 1), 0.0)
        return me

    add(x, 0)
    return nodes


def race(names: np.ndarray, weights: np.ndarray, trees: int, psi: int, limit: float,
         seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrivals (row, tree, time) up to ``limit``: in each tree every one of a row's ``weight``
    copies arrives after an exponential time that the row's name and the tree fix, so a tree's
    first ``psi`` arrivals are a draw without replacement from all copies, wherever rows are.
    A row's copies beyond ``psi`` cannot be among them and are left out."""
    copies = np.minimum(weights, psi).astype(np.int64)
    row = np.repeat(np.arange(len(names)), copies)
    first = np.cumsum(copies) - copies
    nth = np.arange(len(row)) - first[row]
    rows, which, times = [], [], []
    for t in range(trees):
        turn = nth.astype(np.uint64) * np.uint64(trees) + np.uint64(t + 1)
        z = names[row].view(np.uint64) + turn * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0 ** -53
        step = -np.log1p(-u) / (weights[row] - nth)
        at = np.cumsum(step)
        at -= np.concatenate([[0.0], at])[first[row]] if len(row) else 0.0  # the copies of a row arrive in turn
        at = np.where(nth == 0, step, at)  # exactly, whatever rows are beside it
        hit = np.flatnonzero(at <= limit)
        rows.append(row[hit])
        which.append(np.full(len(hit), t))
        times.append(at[hit])
    return np.concatenate(rows), np.concatenate(which), np.concatenate(times)


def race_limit(total: float, psi: int) -> float:
    """A time by which ``psi`` of ``total`` copies have arrived but for a chance of under 1e-9,
    and about ``psi + 8 * sqrt(psi) + 64`` are expected to."""
    share = (psi + 8 * psi ** 0.5 + 64) / max(total, 1)
    return -np.log1p(-share) if share < 0.5 else np.inf


def fit_forest(x: np.ndarray, trees: int = 96, psi: int = 256, seed: int = 7, weights: np.ndarray | None = None,
               drawn: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> dict:
    """Each tree draws ``psi`` rows; a row of weight n stands for n equal rows.

    ``drawn``: arrivals of the rows of ``x`` as of ``race``, where they are already known."""
    if drawn is None:
        drawn = race(np.arange(len(x)), np.ones(len(x)) if weights is None else weights, trees, psi, np.inf, seed)
    row, tree, time = drawn
    order = np.lexsort((row, time, tree))
    row, starts = row[order], np.searchsorted(tree[order], np.arange(trees + 1))
    draws = [row[lo:min(lo + psi, hi)] for lo, hi in zip(starts[:-1], starts[1:])]
    psi = max(map(len, draws), default=0)
    depth = int(np.ceil(np.log2(max(psi, 2))))
    grown = [grow(x[d], np.random.default_rng((seed, t)), depth) for t, d in enumerate(draws) if len(d)]
    parts = [[np.array([n[k] for n in t]) for k in range(5)] for t in grown]
    return {"trees": parts, "norm": float(average_path(max(psi, 2))), "depth": depth}


def anomaly(forest: dict, x: np.ndarray) -> np.ndarray:
    """2 ** (-mean path / expected path): near 1 for rows isolated early."""
    total, rows = np.zeros(len(x)), np.arange(len(x))
    for feature, split, left, right, path in forest["trees"]:
        at = np.zeros(len(x), np.int64)
        for _ in range(forest["depth"]):
            f = feature[at]
            at = np.where(f < 0, at, np.where(x[rows, np.maximum(f, 0)] <= split[at], left[at], right[at]))
        total += path[at]
    return 2.0 ** (-total / max(len(forest["trees"]), 1) / forest["norm"])


def choose_threshold(good: np.ndarray, bad: np.ndarray, max_loss: float) -> float:
    """From histograms over [0, 1]: the threshold with the largest share of bad
    rows above it minus good rows above it, losing at most ``max_loss`` good
    rows. Without rows of both kinds nothing is rejected."""
    if not good.sum() or not bad.sum():
        return 1.0
    above = lambda h: h[::-1].cumsum()[::-1] / h.sum()
    gain = np.where(above(good) <= max_loss, above(bad) - above(good), -1.0)
    return float(np.argmax(gain)) / len(good) if gain.max() > 0 else 1.0


def quality_rules(docs: DataFrame, labels: DataFrame, trees: int = 96, psi: int = 256,
                  max_loss: float = 0.01, min_words: int = 10, max_repeat_pct: int = 20) -> DataFrame:
    """Per row of ``docs``: doc_id, the counts, base_failed, anomaly, threshold, kept.

    Null and empty texts have no words and fail the base rules. Null ids are
    kept and never meet a label. Rows repeated are judged alike. An empty
    table, or labels of one kind only, rejects nothing beyond the base rules."""
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for part in slices(b, "text"):
                c = statistics(text_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c[k]) for k in COUNTS)],
                                                 names=["doc_id", *COUNTS])

    stats = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, schema)
    stats = materialize(stats)
    # rows that repeat are one row with a weight; what comes to the driver is bound by trees and psi
    every = stats.groupBy("doc_id", *COUNTS).agg(F.count("*").alias("times"))
    every = every.withColumn("name", F.xxhash64("doc_id", *COUNTS))
    limit = race_limit(stats.count(), psi)

    def arrive(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            weights = b.column("times").to_numpy().astype(float)
            for lo, hi in cuts(np.minimum(weights, psi).tolist(), 100_000):
                row, tree, time = race(b.column("name").to_numpy()[lo:hi], weights[lo:hi], trees, psi, limit)
                order = np.argsort(row, kind="stable")
                used, n = np.unique(row, return_counts=True)
                edges = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                lists = [pa.ListArray.from_arrays(edges, pa.array(v[order])) for v in (tree, time)]
                keep = b.take(pa.array(used + lo))
                yield pa.RecordBatch.from_arrays([*(keep.column(c) for c in ("doc_id", *COUNTS)), *lists],
                                                 names=["doc_id", *COUNTS, "trees", "times"])

    sample = (every.mapInArrow(arrive, schema + ", trees array<long>, times array<double>").toPandas()
              .sort_values(["doc_id", *COUNTS]))
    flat = [np.concatenate([np.zeros(0, kind), *sample[c]]) for c, kind in (("trees", np.int64), ("times", float))]
    rows = np.repeat(np.arange(len(sample)), sample["trees"].map(len).to_numpy(np.int64))
    forest = fit_forest(features({c: sample[c].to_numpy(np.int64) for c in COUNTS}), trees, psi, drawn=(rows, *flat))

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            c = {k: b.column(k).to_numpy() for k in COUNTS}
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(anomaly(forest, features(c)))],
                                             names=[*b.schema.names, "anomaly"])

    failed = ((F.col("n_words") < min_words)
              | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words")))
    scored = stats.mapInArrow(score, schema + ", anomaly double").withColumn("base_failed", failed)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = (scored.filter(~F.col("base_failed")).join(marks.filter("doc_id is not null and quality is not null"), "doc_id")
             .groupBy((F.col("anomaly") * BINS).cast("int").alias("bin"), "quality").count().collect())
    bins = {q: np.zeros(BINS + 1) for q in (0, 1)}
    for r in known:
        if r["quality"] in bins:
            bins[r["quality"]][r["bin"]] += r["count"]
    threshold = choose_threshold(bins[1], bins[0], max_loss) * (BINS + 1) / BINS
    return scored.withColumns({"threshold": F.lit(threshold),
                               "kept": ~F.col("base_failed") & (F.col("anomaly") < F.lit(threshold))})
