"""Benchmark decontamination by Wu-Manber search over words.

Every window of ``width`` consecutive words of a benchmark item is a search
string; an item with fewer words is one string of its own length. Strings of one
length share a table of shifts: how far the search may jump, from the block of
words that ends at the current place, without passing an occurrence. Blocks with
shift zero lead to the strings of their suffix bucket, picked by first word and
confirmed by direct comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaignlab.llm.common import ROW, doc_key, materialize

# Lower-cases A-Z, keeps a-z, 0-9 and all bytes beyond ASCII, blanks the rest.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


def windows(words: list[bytes], width: int) -> list[tuple]:
    if not words:
        return []
    return [tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]


class WuManber:
    """Search for strings (tuples of words) of one length ``m``."""

    def __init__(self, strings: dict[tuple, list], block: int = 3):
        self.m = m = len(next(iter(strings)))
        self.block = block = min(block, m)
        self.jump = m - block + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, dict[bytes, list]] = {}
        for s, items in strings.items():
            for end in range(block, m + 1):
                b = s[end - block:end]
                self.shift[b] = min(self.shift.get(b, self.jump), m - end)
            self.bucket.setdefault(s[m - block:], {}).setdefault(s[0], []).append((s, items))

    def find(self, words: list[bytes]) -> list[tuple[int, list]]:
        """(start, items) of every occurrence."""
        out, m, block, jump, shift = [], self.m, self.block, self.jump, self.shift
        at, n = m - 1, len(words)
        while at < n:
            b = tuple(words[at - block + 1:at + 1])
            step = shift.get(b, jump)
            if step:
                at += step
                continue
            start = at - m + 1
            for s, items in self.bucket[b].get(words[start], ()):
                if tuple(words[start:at + 1]) == s:
                    out.append((start, items))
            at += 1
        return out


def build(items: list[tuple], width: int) -> list[WuManber]:
    """One search per string length for (item id as text, text) rows."""
    by_length: dict[int, dict[tuple, list]] = {}
    for item, text in items:
        for w in windows(item_words(text), width):
            ids = by_length.setdefault(len(w), {}).setdefault(w, [])
            if item is not None and item not in ids:
                ids.append(item)
    return [WuManber(s) for _, s in sorted(by_length.items())]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_words: int = 500_000) -> DataFrame:
    """Per row of ``docs``: struct ``__row``, n_words, n_hit (words inside any
    occurrence), items (sorted ids, as text, of items with an occurrence).

    The benchmark is searched in blocks of about ``block_words`` words (an item is in one
    block). Each block is one pass over the rows: its tables are built, sent to the tasks
    with its function and dropped before the next; what it finds is written to the
    shared checkpoint folder and merged by document after the last. So what the driver
    and a task hold is bound by a block (and by the longest item), whatever the
    benchmark's size. Null and empty texts have no words and match nothing; an
    item without words neither. Items with a null id mark words, but no id is
    listed. Repeated items or documents count alike; an empty benchmark gives
    zero hits, an empty table no rows."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // (6 * block_words)) + 1
    rows = docs.select(F.struct("*").alias(ROW))
    text = F.coalesce(F.col(f"{ROW}.text").cast("string"), F.lit(""))
    bench = bench.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    block = lambda k: build([(r["item"], r["text"]) for r in
                             bench.filter(F.col("block") == k).distinct().collect()], width)
    if blocks == 1:
        got = rows.withColumn("found", searched(block(0), text))
        spans, items = F.col("found.spans"), F.col("found.items")
    else:
        rows = rows.withColumn("key", doc_key(f"{ROW}.doc_id", f"{ROW}.text"))
        once = rows.select("key", text.alias("text")).dropDuplicates(["key"])  # documents that repeat are searched once
        hits = [materialize(once.select("key", searched(block(k), F.col("text")).alias("found"))
                            .filter(F.size("found.spans") > 0).select("key", "found.spans", "found.items"))
                for k in range(blocks)]
        every = reduce(DataFrame.unionByName, hits).groupBy("key").agg(
            F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        none = searched([], text)  # counts the words
        got = rows.withColumn("found", none).join(every, "key", "left")
        spans = F.coalesce("spans", F.array().cast("array<long>"))
        items = F.coalesce("items", F.array().cast("array<string>"))
    return got.select(ROW, F.col("found.n_words").alias("n_words"), covered(spans).alias("n_hit"),
                      F.array_sort(F.array_distinct(items)).alias("items"))


def searched(tables: list[WuManber], text: Column) -> Column:
    """n_words, spans (starts and ends of occurrences, merged where they meet) and items."""

    @F.pandas_udf("n_words long, spans array<long>, items array<string>")
    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sizes, spans, items = [], [], []
            for t in part:
                words = item_words(t)
                got = sorted(((s, s + w.m, i) for w in tables for s, i in w.find(words)), key=lambda x: x[:2])
                flat: list[int] = []
                for s, e, _ in got:
                    if flat and s <= flat[-1]:
                        flat[-1] = max(flat[-1], e)
                    else:
                        flat += [s, e]
                sizes.append(len(words))
                spans.append(flat)
                items.append(sorted({i for *_, ids in got for i in ids}))
            yield pd.DataFrame({"n_words": np.array(sizes, np.int64), "spans": spans, "items": items})

    return scan(text)


def covered(spans: Column) -> Column:
    """Words inside the union of spans, given as starts and ends in turn."""
    ends = F.transform(F.filter(spans, lambda _, i: i % 2 == 0), lambda s, i: F.struct(
        s.alias("s"), F.element_at(spans, 2 * i + 2).alias("e")))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    return F.aggregate(F.array_sort(ends), start, lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(x["s"], a["to"]))).alias("n"),
        F.greatest(a["to"], x["e"]).alias("to")), lambda a: a["n"])
