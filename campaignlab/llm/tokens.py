"""Token counts by overlap resynchronisation.

A huge text is encoded in overlapping chunks. Two neighbouring chunks are spliced
at a boundary that both encodings share and that is *stable*: tokens on its left
cannot depend on what is on its right and the other way round. Offsets are taken
only in the overlap: its own encoding, with character offsets, tells the tokens
on both sides of a stable place, and they must be the last tokens of the left chunk
and the first of the right one. Where no place of the overlap aligns so, the
overlap is widened, at last to all that is left of the old chunk, so counts always
equal those of encoding the text in one call, while memory is bound by the chunk.

Why the boundaries are stable for this vocabulary: its normaliser (NFC, white
space to one space, per-character lower case) never joins characters across
ASCII white space, its pre-tokeniser drops white space, no pre-token and no
special string holds any; a digit is a pre-token of its own, so the places
between an ASCII digit and an ASCII letter or digit are boundaries too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignlab.llm.common import ROW, cuts, per_worker

# ASCII white space to the right, or ASCII digit next to an ASCII letter or digit.
STABLE = re.compile(r"(?=[ \t\n\r])|(?<=[0-9])(?=[0-9A-Za-z])|(?<=[A-Za-z])(?=[0-9])")


class TokenCounter:
    """Counts tokens of texts; ``chunk``, ``overlap`` and ``huge`` are in characters.

    Texts of up to ``huge`` characters (``chunk``, where it is not given) are cut at
    white space (the same proof) and the library's count of each piece is remembered,
    for up to ``memory`` pieces of at most 48 characters. ``divider`` is a special token
    of the tokenizer: new pieces are counted by the hundred, with one between them.
    ``cache`` is how many pre-tokens the library itself remembers."""

    def __init__(self, path: str, chunk: int = 2048, overlap: int = 64, huge: int | None = None,
                 memory: int = 700_000, divider: str = "<|startoftext|>", cache: int = 200_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        if hasattr(self.tok.model, "_resize_cache"):
            self.tok.model._resize_cache(cache)
        self.chunk, self.overlap, self.huge, self.memory = chunk, overlap, chunk if huge is None else huge, memory
        special = {t.content: k for k, t in self.tok.get_added_tokens_decoder().items() if t.special}
        self.divider, self.divider_id = divider, special.get(divider)
        self.known: dict[str, int] = {}
        self.widened = 0

    def count(self, texts: list[str]) -> list[int]:
        return self.count_column(pa.array(texts, pa.string())).tolist()

    def count_column(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text of a string column without nulls."""
        out = np.zeros(len(texts), np.int64)
        huge = pc.greater(pc.utf8_length(texts), self.huge).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(huge):
            out[i] = self.resynchronise(texts[int(i)].as_py())
        words = pc.ascii_split_whitespace(texts.filter(pa.array(~huge)))
        coded = words.flatten().dictionary_encode()
        size = self.remembered(coded.dictionary.to_pylist())
        before = np.concatenate([[0], np.cumsum(size[coded.indices.to_numpy()])])
        edges = words.offsets.to_numpy()
        out[~huge] = np.diff(before[edges - edges[0]])
        return out

    def remembered(self, pieces: list[str]) -> np.ndarray:
        if len(self.known) > self.memory:
            self.known.clear()
        known = self.known
        counts = self.sizes([p for p in pieces if p not in known])
        known.update((p, n) for p, n in counts.items() if len(p) <= 48)
        return np.array([known[p] if p in known else counts[p] for p in pieces], np.int64)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def sizes(self, pieces: list[str], at_once: int = 100) -> dict[str, int]:
        """Tokens of each piece. The library cuts a text at special strings before
        all else, so pieces between dividers are encoded as if alone."""
        if self.divider_id is None:
            return dict(zip(pieces, map(len, self.ids(pieces))))
        alone = [p for p in pieces if self.divider in p]
        others = [p for p in pieces if self.divider not in p] if alone else pieces
        out = dict(zip(alone, map(len, self.ids(alone))))
        groups = [others[k:k + at_once] for k in range(0, len(others), at_once)]
        mark = self.divider
        for group, ids in zip(groups, self.ids([f"{mark}{mark.join(g)}{mark}" for g in groups])):
            out.update(zip(group, (np.diff(np.flatnonzero(ids == self.divider_id)) - 1).tolist()))
        return out

    def splice(self, text: str, lo: int, hi: int, zone, left: np.ndarray, right: np.ndarray) -> tuple[int, int, int] | None:
        """The last stable place of the overlap text[lo:hi] where the encodings of both chunks
        agree, the number of tokens the right chunk has before it and the left one after it."""
        ids = np.array(zone.ids, np.int32)
        starts, ends = np.array(zone.offsets, np.int64).reshape(-1, 2).T + lo
        for m in reversed(list(STABLE.finditer(text, lo + 1, hi))):
            p = m.start()
            head, tail = int((ends <= p).sum()), int((starts >= p).sum())
            if (head and tail and head + tail == len(ids) and np.array_equal(ids[:head], right[:head])
                    and np.array_equal(ids[head:], left[-tail:])):
                return p, head, tail
        return None

    def resynchronise(self, text: str, at_once: int = 32) -> int:
        n, total = len(text), 0
        spans = [(max(0, k - self.overlap), k, min(n, k + self.chunk)) for k in range(0, n, self.chunk)]
        start = end = taken = 0  # of the current chunk: its first place, its end, tokens that the chunk before has
        left = None
        for g in range(0, len(spans), at_once):
            group = spans[g:g + at_once]
            zones = self.tok.encode_batch([text[lo:k] for lo, k, _ in group], add_special_tokens=False)
            for (lo, _, hi), right, zone in zip(group, self.ids([text[lo:hi] for lo, _, hi in group]), zones):
                if left is None:
                    left, end = right, hi
                    continue
                found = self.splice(text, lo, end, zone, left, right)
                while found is None:
                    self.widened += 1
                    lo = end - 4 * (end - lo)
                    if lo <= start:  # the overlap holds all that is left of the old chunk
                        break
                    right, zone = self.ids([text[lo:hi]])[0], self.tok.encode(text[lo:end], add_special_tokens=False)
                    found = self.splice(text, lo, end, zone, left, right)
                if found is None:  # one chunk from the last splice on, which is stable
                    left, end, taken = self.ids([text[start:hi]])[0], hi, 0
                    continue
                total += len(left) - taken - found[2]
                start, taken = found[:2]
                left, end = right, hi
        return total + len(left) - taken


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, chunk: int = 2048, overlap: int = 64,
                 huge: int = 8192, text: str = "text") -> DataFrame:
    """All columns of ``docs`` in struct ``__row`` with ``n_bytes`` (UTF-8),
    ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted
    each; an empty table gives an empty result; extra columns of any name stay
    inside the struct. ``tokenizer`` is a file every executor can read."""
    rows = docs.select(F.struct("*").alias(ROW))

    @F.arrow_udf("long")
    def tokens(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = per_worker(("counter", tokenizer, chunk, overlap, huge),
                             lambda: TokenCounter(tokenizer, chunk, overlap, huge))
        for part in parts:
            sizes = pc.binary_length(part).to_pylist()
            counts = [counter.count_column(part.slice(lo, hi - lo)) for lo, hi in cuts(sizes, 16_000_000)]
            yield pa.array(np.concatenate([np.zeros(0, np.int64), *counts]))

    body = F.coalesce(F.col(f"{ROW}.`{text}`"), F.lit(""))
    return (rows.withColumns({"n_bytes": F.octet_length(body).cast("long"), "n_tokens": tokens(body)})
            .withColumn("over_limit", F.col("n_tokens") > limit))
