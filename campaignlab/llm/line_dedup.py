"""Line dedup by pairwise alignment.

1. Every document becomes the sequence of its non-blank lines (hash, words).
   Each line starts a *run*: the shortest stretch of lines from it on that holds
   ``min_words`` words; it also ends one, the shortest such stretch up to it.
   Run hashes are rare: short boilerplate makes none alone.
2. The earliest document with a run owns it. A document is paired with the
   owners of its runs only, so the pairs grow with the rows and never with the
   square of a group, whatever the frequency of a run; no run is left out. Two
   documents that share a block of ``min_words`` words share the run that
   starts it, and its owner holds that same run.
3. A pair is aligned by patience diff over line hashes; common blocks of
   ``min_words`` words or more are deleted from the later document. Nothing else is
   ever deleted: run hashes find the pairs and tell what is left to align.
4. One alignment cannot hold crossing blocks, takes one copy of a repeated
   passage and may split a block. So where lines of a run that the owner holds are
   left, that stretch of the later document is aligned again, with the stretch
   of the owner that holds the run, until none is left. Every line of a
   common block lies in a run inside it, from the line on or up to the block's end,
   so no line of any block of ``min_words`` words an earlier document holds stays.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignlab.llm.common import ROW, doc_key, materialize, text_bytes


def line_sequence(text: bytes) -> tuple[list[int], list[int], list[int]]:
    """Of the non-blank lines: position among all lines, hash, words."""
    import xxhash

    pos, hashes, words = [], [], []
    for i, line in enumerate(text.split(b"\n")):
        w = len(line.split())
        if w:
            pos.append(i)
            hashes.append(xxhash.xxh64_intdigest(line.strip()) - 2**63)
            words.append(w)
    return pos, hashes, words


def runs(hashes: list[int], words: list[int], min_words: int) -> list[int]:
    """Hash of the shortest run of at least ``min_words`` words from each line."""
    import struct

    import xxhash

    out, total, end = [], 0, 0
    for i, w in enumerate(words):
        while total < min_words and end < len(words):
            total += words[end]
            end += 1
        if total < min_words:
            break
        out.append(xxhash.xxh64_intdigest(struct.pack(f"<{end - i}q", *hashes[i:end])) - 2**63)
        total -= w
    return out


def places(hashes: list[int], words: list[int], min_words: int) -> dict[int, list[int]]:
    """By hash of a run, starting or ending at any line: its lines, then where it lies,
    as starts and ends in turn, merged where they meet."""
    import struct

    import xxhash

    spans, total, at = set(), 0, 0
    for i, w in enumerate(words):
        while total < min_words and at < len(words):
            total += words[at]
            at += 1
        if total < min_words:
            break
        spans.add((i, at))
        total -= w
    total, at = 0, 0
    for i, w in enumerate(words):
        total += w
        while total - words[at] >= min_words:
            total -= words[at]
            at += 1
        if total >= min_words:
            spans.add((at, i + 1))
    out: dict[int, list[int]] = {}
    for i, end in sorted(spans):
        flat = out.setdefault(xxhash.xxh64_intdigest(struct.pack(f"<{end - i}q", *hashes[i:end])) - 2**63, [end - i])
        if len(flat) > 1 and i <= flat[-1]:
            flat[-1] = max(flat[-1], end)
        else:
            flat += [i, end]
    return out


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of (a, b), sorted by a, with b rising: patience sorting."""
    tops, ends, back = [], [], []
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        if at == len(tops):
            tops.append(b)
            ends.append(k)
        else:
            tops[at], ends[at] = b, k
        back.append(ends[at - 1] if at else -1)
    k, out = (ends[-1] if ends else -1), []
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience_blocks(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Aligned common blocks (start in a, start in b, length): lines unique in
    both stretches anchor the alignment, anchors grow over equal neighbours,
    and what lies between them is aligned in the same way."""
    blocks, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        head = 0
        while a0 + head < a1 and b0 + head < b1 and a[a0 + head] == b[b0 + head]:
            head += 1
        if head:
            blocks.append((a0, b0, head))
            a0, b0 = a0 + head, b0 + head
        tail = 0
        while a0 < a1 - tail and b0 < b1 - tail and a[a1 - tail - 1] == b[b1 - tail - 1]:
            tail += 1
        if tail:
            a1, b1 = a1 - tail, b1 - tail
            blocks.append((a1, b1, tail))
        if a0 >= a1 or b0 >= b1:
            continue
        once = [{}, {}]
        for side, seq, lo, hi in ((0, a, a0, a1), (1, b, b0, b1)):
            for i in range(lo, hi):
                once[side][seq[i]] = -1 if seq[i] in once[side] else i
        anchors = increasing([(i, once[1][h]) for h, i in once[0].items() if i >= 0 and once[1].get(h, -1) >= 0])
        if not anchors:
            common = once[0].keys() & once[1].keys()
            if common:  # no line is unique in both: anchor the first common one
                i = next(i for i in range(a0, a1) if a[i] in common)
                anchors = [(i, next(j for j in range(b0, b1) if b[j] == a[i]))]
        if anchors:
            edge = [(a0, b0), *((i + 1, j + 1) for i, j in anchors)]
            stop = [*anchors, (a1, b1)]
            blocks += [(i, j, 1) for i, j in anchors]
            todo += [(x, i, y, j) for (x, y), (i, j) in zip(edge, stop) if x < i and y < j]
    return blocks


def common_lines(later: list[int], words: list[int], earlier: list[int], min_words: int) -> list[int]:
    """Indices in ``later`` of the aligned common blocks of ``min_words`` words."""
    joined: list[list[int]] = []
    for i, j, n in sorted(patience_blocks(later, earlier)):
        if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
            joined[-1][2] += n
        else:
            joined.append([i, j, n])
    return [k for i, _, n in joined if sum(words[i:i + n]) >= min_words for k in range(i, i + n)]


def aligned_lines(later: list[int], words: list[int], earlier: list[int], earlier_words: list[int],
                  owned: list[tuple[int, list[int]]], min_words: int) -> list[int]:
    """Indices in ``later`` of the common blocks of ``min_words`` words that rounds of alignment
    with ``earlier`` find. ``owned``: runs of ``later`` (hash, ``places``) that ``earlier`` holds."""
    off = bytearray(len(later))

    def delete(start: int, gone: list[int]) -> bool:
        for k in gone:
            off[start + k] = 1
        return bool(gone)

    delete(0, common_lines(later, words, earlier, min_words))
    held: dict[int, list[int]] | None = None
    for run, (n, *flat) in owned:
        for lo, hi in zip(flat[::2], flat[1::2]):
            k = off.find(0, lo, hi)
            while k >= 0:  # line k of the run is left
                held = places(earlier, earlier_words, min_words) if held is None else held
                j = held[run][1]
                # the stretch of the run that holds line k: copies of a run may overlap
                start = next((s for s in range(max(lo, k - n + 1), min(k, hi - n) + 1) if later[s:s + n] == later[lo:lo + n]), lo)
                if not delete(start, common_lines(later[start:start + n], words[start:start + n], earlier[j:j + n], min_words)):
                    break
                k = off.find(0, k, hi)
    return [k for k, gone in enumerate(off) if gone]


def dedup_lines(docs: DataFrame, min_words: int = 25) -> DataFrame:
    """Struct ``__row`` of each row of ``docs`` with ``text`` rewritten, and
    ``n_lines`` (all lines before), ``deleted`` (sorted positions of deleted lines).

    Earlier is the smaller doc_id (null last), then the smaller text hash. Rows
    that repeat id and text are one document and are treated alike. Null texts
    stay null, blank lines are never compared and stay; lines are compared
    without white space at their ends. Other columns are kept as they are."""
    rows = docs.select(F.struct("*").alias(ROW))
    rows = rows.withColumn("key", doc_key(f"{ROW}.doc_id", f"{ROW}.text"))

    def sequences(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            seqs = [line_sequence(t) for t in text_bytes(b.column("text"))]
            cols = [pa.array([s[k] for s in seqs], pa.list_(pa.int32() if k != 1 else pa.int64())) for k in range(3)]
            held = [places(s[1], s[2], min_words) for s in seqs]
            cols.append(pa.array([list(h) for h in held], pa.list_(pa.int64())))
            cols.append(pa.array([list(h.values()) for h in held], pa.list_(pa.list_(pa.int32()))))
            yield pa.RecordBatch.from_arrays([b.column("d"), b.column("x"), *cols],
                                             names=["d", "x", "pos", "hashes", "words", "runs", "places"])

    seqs = materialize(rows.select("key.*", F.col(f"{ROW}.text").cast("string").alias("text"))
                       .mapInArrow(sequences, "d long, x long, pos array<int>, hashes array<long>, words array<int>, "
                                              "runs array<long>, places array<array<int>>")
                       .filter(F.size("runs") > 0))
    keyed = (seqs.select(F.struct("d", "x").alias("key"), F.explode(F.arrays_zip("runs", "places")).alias("r"))
             .select("key", F.col("r.runs").alias("run"), F.col("r.places").alias("places")))
    owners = materialize(keyed.groupBy("run").agg(F.min("key").alias("owner"), F.max("key").alias("last"))
                         .filter("owner <> last").select("run", "owner"))
    pairs = (keyed.join(owners, "run").filter("key <> owner").groupBy("key", "owner")
             .agg(F.collect_set(F.struct("run", "places")).alias("owned")))
    side = seqs.select(F.struct("d", "x").alias("key"), "pos", "hashes", "words")
    other = seqs.dropDuplicates(["d", "x"]).select(F.struct("d", "x").alias("owner"), F.col("hashes").alias("earlier"), F.col("words").alias("earlier_words"))
    both = (pairs.join(side.dropDuplicates(["key"]), "key").join(other, "owner")
            .select("key.*", "pos", "hashes", "words", "earlier", "earlier_words", "owned"))

    def align(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            c = [b.column(n).to_pylist() for n in ("pos", "hashes", "words", "earlier", "earlier_words", "owned")]
            out = []
            for p, h, w, e, e_words, owned in zip(*c):
                gone = aligned_lines(h, w, e, e_words, [(o["run"], o["places"]) for o in owned], min_words)
                out.append([p[k] for k in gone])
            yield pa.RecordBatch.from_arrays([b.column("d"), b.column("x"), pa.array(out, pa.list_(pa.int32()))],
                                             names=["d", "x", "gone"])

    gone = (both.mapInArrow(align, "d long, x long, gone array<int>").filter(F.size("gone") > 0)
            .groupBy(F.struct("d", "x").alias("key"))
            .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("deleted")))

    @F.pandas_udf("string")
    def cut(text: pd.Series, deleted: pd.Series) -> pd.Series:
        def keep(t, gone):
            if t is None or gone is None or not len(gone):
                return t
            off = set(gone)
            return "\n".join(line for i, line in enumerate(t.split("\n")) if i not in off)

        return pd.Series([keep(t, g) for t, g in zip(text, deleted)], dtype=object)

    joined = rows.join(gone, "key", "left")
    text = F.col(f"{ROW}.text")
    return joined.select(
        F.col(ROW).withField("text", F.when(F.col("deleted").isNull(), text).otherwise(cut(text, F.col("deleted")))).alias(ROW),
        F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0)).alias("n_lines"),
        F.coalesce("deleted", F.array().cast("array<int>")).alias("deleted"))
