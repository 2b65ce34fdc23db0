"""Chat formatting by columnar byte assembly.

A batch of turns becomes one preallocated buffer: lengths of all segments
(header, role, text, footer) give cumulative offsets, and numpy scatter indices
copy the bytes of the Arrow columns to their places without touching rows.

Each turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside a
text get a backslash after their first character, one more if they have some
already; taking one away restores the text exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Control strings of common chat templates.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
HEAD, MID, FOOT = b"<|im_start|>", b"\n", b"<|im_end|>\n"
TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
ESCAPE = rf"([<\[])(\\*)({TAILS})"
UNESCAPE = re.compile(rf"([<\[])\\(\\*)({TAILS})")
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
PART = "conv_id long, block long, part long, formatted string, spans binary, n_turns long"


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def escaped(column, role: bool = False):
    """The column with null as empty and control strings escaped."""
    import pyarrow as pa
    import pyarrow.compute as pc

    c = pc.fill_null(column.cast(pa.large_string()), "")
    if role:
        c = pc.replace_substring(pc.replace_substring(c, "\\", "\\\\"), "\n", "\\n")
    return pc.replace_substring_regex(c, ESCAPE, r"\1\\\2\3")


def content(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of a large_string column."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at[:-1], np.diff(at)


def scatter(out: np.ndarray, to: np.ndarray, source: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    data, start, size = source
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(to, size) + step] = data[np.repeat(start, size) + step]


def assemble(role, text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buffer of all turns, the start of each turn (and the end), and the
    [start, end) of each text, in bytes."""
    r, t = content(escaped(role, role=True)), content(escaped(text))
    sizes = np.stack([np.full(len(r[2]), len(HEAD)), r[2], np.full(len(r[2]), len(MID)), t[2],
                      np.full(len(r[2]), len(FOOT))], 1)
    ends = np.cumsum(sizes.ravel()).reshape(sizes.shape)
    starts = ends - sizes
    out = np.empty(int(ends[-1, -1]) if len(ends) else 0, np.uint8)
    for k, fixed in ((0, HEAD), (2, MID), (4, FOOT)):
        out[starts[:, k][:, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    scatter(out, starts[:, 1], r)
    scatter(out, starts[:, 3], t)
    edge = np.append(starts[:, 0], len(out))
    return out, edge, np.stack([starts[:, 3], ends[:, 3]], 1)


def format_batches(batches: Iterator) -> Iterator:
    import pyarrow as pa
    import pyarrow.compute as pc

    last, part = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        out, edge, inner = assemble(b.column("role"), b.column("text"))
        key = [np.asarray(pc.fill_null(b.column(c), -1 << 62)) for c in ("conv_id", "block")]
        new = np.ones(b.num_rows, bool)
        new[1:] = (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])
        first = np.flatnonzero(new)
        stop = np.append(first[1:], b.num_rows)
        assistant = np.asarray(pc.fill_null(pc.equal(b.column("role"), "assistant"), False))
        whole = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(edge[np.append(first, b.num_rows)].copy()),
                                                 pa.py_buffer(out))
        spans, parts = [], []
        for i, j in zip(first, stop):
            mine = inner[i:j][assistant[i:j]] - edge[i]
            spans.append(mine.astype("<i8").tobytes())
            here = (key[0][i], key[1][i])
            part = part + 1 if here == last else 0
            last = here
            parts.append(part)
        yield pa.RecordBatch.from_arrays([b.column("conv_id").take(pa.array(first)), b.column("block").take(pa.array(first)),
                                          pa.array(parts, pa.int64()), whole.cast(pa.string()),
                                          pa.array(spans, pa.binary()), pa.array(stop - first, pa.int64())],
                                         names=["conv_id", "block", "part", "formatted", "spans", "n_turns"])


def format_chat(conversations: DataFrame, block_turns: int = 256) -> DataFrame:
    """Formatted conversations: conv_id, block, part, formatted, spans (pairs of
    little-endian int64: bytes of ``formatted`` under the loss mask, the
    assistant texts) and n_turns.

    A conversation is the concatenation of its rows by block and part; blocks
    of ``block_turns`` turn numbers are dealt apart, so that one huge
    conversation is spread over tasks, and a block larger than an Arrow batch
    continues in the next part. Turns are ordered by turn, then role and text,
    so ties and repeated rows have a defined place. Null text and role count as
    empty, null turns come first, rows with a null conv_id form one
    conversation. An empty table gives an empty result; other columns are not
    read."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("block", F.floor(F.col("turn") / block_turns))
    return (rows.repartition("conv_id", "block")
            .sortWithinPartitions("conv_id", "block", "turn", "role", "text").mapInArrow(format_batches, PART))


def digest_batches(batches: Iterator) -> Iterator:
    """Reads formatted parts back: turns and texts under the mask, hashed as they pass."""
    import pyarrow as pa

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def result(conv, s):
        return conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]

    def frame(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    now, state = None, None
    for b in batches:
        rows = []
        for conv, text, spans in zip(b.column("conv_id").to_pylist(), b.column("formatted").to_pylist(),
                                     b.column("spans").to_pylist()):
            if state is None or conv != now:
                if state is not None:
                    rows.append(result(now, state))
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for m in TURN.finditer(text):
                state[0] += 1
                state[1].update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
            raw = text.encode()
            for i, j in np.frombuffer(spans, "<i8").reshape(-1, 2):
                loss = unescape(raw[i:j].decode())
                state[2] += len(loss)
                state[3].update(loss.encode())
            state[4] += len(text)
        if rows:
            yield frame(rows)
    if state is not None:
        yield frame([result(now, state)])


def chat_digests(parts: DataFrame) -> DataFrame:
    """One row per conversation, read back from the output of ``format_chat``:
    counts and hashes of its turns and of the text under the loss mask. Parts
    stream through in order; memory is bound by one part."""
    return (parts.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part")
            .mapInArrow(digest_batches, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                        "loss_sha256 string, formatted_chars long"))
