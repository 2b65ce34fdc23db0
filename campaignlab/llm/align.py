"""Cross-tokenizer alignment as an Arrow pipeline.

Texts are encoded by tokenizer A (byte-level BPE) and B (pieces with byte
fallback). The token lists of a batch are flattened, their parent indices name
the documents, running sums of the tokens' byte lengths, less each document's
start, give byte ends, and an Acero hash join on (document, end) gives the links:
the pairs of A and B tokens that end together. Places where both end cut a
document into groups. ``Table.group_by`` counts the id pairs of a task, Spark adds
the partial counts up, and a second pass over the written links looks them up.

Texts are cut before a space that stands after a non-space character and before any
character. Both tokenizers end a token there and neither looks across: A's
expression takes a space only at the start of a match, and no piece of B holds a
space after another character (checked when the vocabulary is loaded). So each
distinct stretch is encoded once and remembered; a very long text is aligned in
pieces of such stretches, and memory is bound by the piece.

Linked tokens end at one byte of one text, so the bytes of one are a suffix of the
other's: possible pairs depend on the two vocabularies alone (``pair_universe``) and
are numbered beforehand. That bounds the table of counts, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaignlab.llm.common import ROW, cuts, per_worker, slices
from campaignlab.session import ensure_checkpoint_dir

CUT = re.compile(r"(?<=\S) (?=.)", re.S)


def byte_alphabet() -> dict[str, int]:
    """Character of the byte-level alphabet -> byte: printable bytes stand for
    themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_vocabulary(tok) -> list[bytes]:
    """Bytes of every entry of a byte-level tokenizer; added tokens in UTF-8."""
    alphabet, out = byte_alphabet(), [b""] * tok.get_vocab_size()
    for entry, k in tok.get_vocab().items():
        out[k] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
    return out


def piece_vocabulary(sp) -> list[bytes]:
    """Bytes of every piece: U+2581 is a space, <0xHH> the byte HH."""
    out = []
    for k in range(sp.vocab_size()):
        piece = sp.id_to_piece(k)
        if re.search("[^▁]▁", piece):
            raise ValueError(f"piece {k} holds a space after another character: texts can't be cut at spaces")
        m = re.fullmatch("<0x([0-9A-Fa-f]{2})>", piece)
        out.append(bytes([int(m[1], 16)]) if m else piece.replace("▁", " ").encode())
    return out


def pair_universe(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sorted codes ``a * len(b) + b`` of all pairs where one entry's bytes are a
    suffix of the other's: the only ones that can end together."""
    of_a: dict[bytes, list[int]] = {}
    of_b: dict[bytes, list[int]] = {}
    for entries, index in ((a, of_a), (b, of_b)):
        for k, x in enumerate(entries):
            index.setdefault(x, []).append(k)
    out = {i * len(b) + j for i, x in enumerate(a) for s in range(len(x) + 1) for j in of_b.get(x[s:], ())}
    out |= {i * len(b) + j for j, x in enumerate(b) for s in range(1, len(x) + 1) for i in of_a.get(x[s:], ())}
    return np.array(sorted(out), np.int64)


class Aligner:
    """Aligns texts by tokenizers in the two files. Remembers up to ``memory``
    stretches; ``piece`` bounds the UTF-8 bytes of a text aligned at a time."""

    def __init__(self, a_path: str, b_path: str, memory: int = 400_000, piece: int = 2_000_000):
        import pyarrow as pa
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        a, b = byte_vocabulary(self.a), piece_vocabulary(self.b)
        self.bytes = {"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())}
        self.sizes = {k: np.array([len(x) for x in v], np.int64) for k, v in (("a", a), ("b", b))}
        self.universe, self.width = pair_universe(a, b), len(b)
        self.codes = pa.array(self.universe)
        # each id in decimal with the sign that follows it: inside a group, or at its end
        self.shown = pa.array([f"{k}{sign}" for sign in ",|" for k in range(len(a))]
                              + [f"{k}{sign}" for sign in ",;" for k in range(len(b))], pa.string())
        self.memory, self.piece = memory, piece
        self.forget()

    def forget(self) -> None:
        import pyarrow as pa

        ids = pa.list_(pa.int32())
        self.known = {"word": pa.array([], pa.string()), "a": pa.array([], ids), "b": pa.array([], ids),
                      "good": pa.array([], pa.bool_())}

    def learn(self, words) -> None:
        """Encode stretches (each follows a space) and check their bytes."""
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = words.to_pylist()
        new = {"word": words, "a": self.encode_a(plain), "b": id_lists(self.b.encode(plain, num_threads=1))}
        want = pc.binary_join_element_wise("", words, " ").cast(pa.binary())  # a space before each
        same = [pc.equal(pc.binary_join(pa.ListArray.from_arrays(new[k].offsets, self.bytes[k].take(new[k].values)), b""),
                         want) for k in "ab"]
        new["good"] = pc.and_(*same)
        self.known = {k: pa.concat_arrays([v, new[k]]) for k, v in self.known.items()}

    def encode_a(self, words: list[str], at_once: int = 500):
        """Token ids by A of every stretch. Many are encoded as one text, which
        is cut at the stretches' ends again: there a token ends. A stretch that
        ends with white space (the end of its text) ends such a text too."""
        import pyarrow as pa

        texts, run = [], []
        for w in words:
            run.append(w)
            if len(run) == at_once or w[-1].isspace():
                texts.append(" " + " ".join(run))
                run = []
        if run:
            texts.append(" " + " ".join(run))
        ids = np.concatenate([np.array(e.ids, np.int32)
                              for e in self.a.encode_batch_fast(texts, add_special_tokens=False)])
        size = np.array([len(w.encode()) + 1 for w in words], np.int64)
        until = np.searchsorted(np.cumsum(self.sizes["a"][ids]), np.cumsum(size)) + 1
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], until]).astype(np.int32)), pa.array(ids))

    def places(self, words):
        """Row of ``known`` of every stretch."""
        import pyarrow as pa
        import pyarrow.compute as pc

        coded = words.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.known["word"])
        if at.null_count:
            new, n = at.is_null(), len(self.known["word"])
            self.learn(coded.dictionary.filter(new))
            at = pc.replace_with_mask(at, new, pa.array(np.arange(n, len(self.known["word"]), dtype=np.int32)))
        return at.take(coded.indices)

    def batch(self, texts: list[str | None]) -> dict:
        """Counts, digests and numbered pairs (with ``of``, their text) of texts."""
        n = len(texts)
        out = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")} | {"sha": [""] * n}
        stretches = [CUT.split(t) if t else [] for t in texts]
        size = [len(t.encode()) if t else 0 for t in texts]
        pairs = []
        for lo, hi in cuts(size, self.piece):
            if hi > lo + 1 or size[lo] <= self.piece:
                pieces = [(stretches[lo:hi], size[lo:hi])]
            else:  # one very long text
                part = stretches[lo]
                long = [len(w.encode()) + 1 for w in part]
                pieces = [([part[x:y]], [sum(long[x:y]) - 1]) for x, y in cuts(long, self.piece)]
            hashes: dict[int, object] = {}
            found, bad = [], set()
            for words, sizes in pieces:
                got = self.align(words, sizes)
                bad |= set(got["bad"])
                for k in ("n_a", "n_b", "n_groups", "n_links"):
                    out[k][lo:hi] += got[k]
                for d, shown in got["shown"]:
                    if d in hashes:
                        hashes[d].update(b";")
                    hashes.setdefault(d, hashlib.sha256()).update(shown)
                found.append(got["pairs"])
            for d in bad:  # its bytes differ in one of the pieces
                for k in ("n_a", "n_b", "n_groups", "n_links"):
                    out[k][lo + d] = 0
            for d in hashes.keys() - bad:
                out["sha"][lo + d] = hashes[d].hexdigest()
            key = np.concatenate(found)
            if bad:
                key = key[~np.isin(key // len(self.universe), list(bad))]
            pairs.append(key + lo * len(self.universe))
        key = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
        out["of"], out["pair"] = np.divmod(key, len(self.universe))
        return out

    def align(self, stretches: list[list[str]], sizes: list[int]) -> dict:
        """One piece: texts as lists of stretches, with their bytes in UTF-8."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.known["word"]) > self.memory or self.known["word"].nbytes > 32 * self.memory:
            self.forget()
        lists = pa.array(stretches, pa.list_(pa.string()))
        doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        at = self.places(lists.flatten())
        good = self.known["good"].take(at).to_numpy(zero_copy_only=False)
        bad = np.unique(doc[~good])
        if len(bad):  # else all take part
            keep = ~np.isin(doc, bad)
            doc, at = doc[keep], at.filter(pa.array(keep))
        n = len(stretches)
        out = {"bad": bad.tolist(), "shown": [], "pairs": np.zeros(0, np.int64)}
        start = np.zeros(n + 1, np.int64)  # bytes before each text, its space included
        start[1:] = [size + 1 if w else 0 for w, size in zip(stretches, sizes)]
        start[1 + bad] = 0
        start = np.cumsum(start)
        ids, owner, end = {}, {}, {}
        for k in "ab":
            tokens = self.known[k].take(at)
            ids[k] = tokens.flatten().to_numpy()
            owner[k] = doc[pc.list_parent_indices(tokens).to_numpy()]
            end[k] = np.cumsum(self.sizes[k][ids[k]])  # over the piece; less start[owner], over the text
        side = lambda k, row: pa.table({"doc": owner[k].astype(np.int32),
                                        "end": end[k] - start[owner[k]], row: np.arange(len(ids[k]), dtype=np.int64)})
        links = side("a", "i").join(side("b", "j"), keys=["doc", "end"], join_type="inner", use_threads=False)
        i, j = links["i"].to_numpy(), links["j"].to_numpy()
        order = np.argsort(i, kind="stable")  # a join keeps no order
        i, j = i[order], j[order]
        both = end["a"][i]
        both = both[np.diff(both, append=-1) != 0]  # ends of groups
        for k in "ab":
            out[f"n_{k}"] = np.bincount(owner[k], minlength=n)
        out["n_links"] = np.bincount(owner["a"][i], minlength=n)
        out["n_groups"] = np.bincount(np.searchsorted(start, both, "left") - 1, minlength=n)
        linked = pa.array(ids["a"][i].astype(np.int64) * self.width + ids["b"][j])
        numbers = pc.index_in(linked, value_set=self.codes).to_numpy(zero_copy_only=False)
        out["pairs"] = owner["a"][i] * len(self.universe) + numbers
        # Text of the groups: each group's A tokens, then its B tokens.
        group = {k: np.searchsorted(both, end[k], "left") for k in "ab"}
        until = {k: np.cumsum(np.bincount(group[k], minlength=len(both))) for k in "ab"}
        place = {"a": np.arange(len(ids["a"])) + (until["b"] - np.bincount(group["b"], minlength=len(both)))[group["a"]],
                 "b": np.arange(len(ids["b"])) + until["a"][group["b"]]}
        code = np.empty(len(ids["a"]) + len(ids["b"]), np.int64)
        for k, base in (("a", 0), ("b", 2 * len(self.sizes["a"]))):
            last = np.arange(len(ids[k])) + 1 == until[k][group[k]]
            code[place[k]] = base + last * len(self.sizes[k]) + ids[k]
        shown = self.shown.take(pa.array(code))
        offsets, data = np.frombuffer(shown.buffers()[1], np.int32), memoryview(shown.buffers()[2] or b"")
        stop = np.cumsum(out["n_a"] + out["n_b"])
        for d in np.flatnonzero(out["n_a"]):
            lo, hi = offsets[stop[d] - out["n_a"][d] - out["n_b"][d]], offsets[stop[d]]
            out["shown"].append((int(d), data[lo:hi - 1]))
        return out


def id_lists(ids: list[list[int]]):
    """An Arrow list array of lists of ids."""
    import itertools

    import pyarrow as pa

    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def added(tables: list):
    """Partial counts by pair, added up."""
    import pyarrow as pa

    return pa.concat_tables(tables).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, keep: tuple[str, ...] = ("doc_id",),
                     text: str = "text", slice_bytes: int = 2_000_000) -> DataFrame:
    """Per row of ``docs``: struct ``__row`` of the columns ``keep``, n_a, n_b (tokens),
    n_groups, n_links, n_best (links whose id pair is the most frequent of its B id in
    the corpus, ties included), count_sum (over links, of their pair's count) and
    groups_sha256 (of ``a1,a2|b1;a3|b2,b3``: ids of each group).

    Null and empty texts, and those that one of the tokenizers does not give back
    byte for byte (a U+2581 in the text), have zeros and an empty digest and take no part in the
    counts. Repeated rows count each; very long texts are aligned in pieces of
    ``slice_bytes``; an empty table gives no rows; other columns are not read.
    The two files must be readable on every executor."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias(ROW), F.col(f"`{text}`").cast("string").alias("text"))
    counts = [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField(ROW, rows.schema[ROW].dataType), *counts,
                           T.StructField("groups_sha256", T.StringType()),
                           T.StructField("pairs", T.ArrayType(T.IntegerType())), T.StructField("pair", T.IntegerType()), T.StructField("n", T.LongType())])

    def encode(batches: Iterator) -> Iterator:
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        aligner = per_worker(("aligner", a_path, b_path, slice_bytes), lambda: Aligner(a_path, b_path, piece=slice_bytes))
        partial = []

        def record(size: int, **cols):
            """A batch of the written table; columns that are not given are null."""
            missing = {f.name: pa.nulls(size, kinds[f.name]) for f in schema if f.name not in cols}
            return pa.RecordBatch.from_arrays([cols[c] if c in cols else missing[c] for c in schema.names], schema.names)

        kinds = {"groups_sha256": pa.string(), "pairs": pa.list_(pa.int32()), "part": pa.int32(), "pair": pa.int32()}
        kinds |= {f.name: pa.int64() for f in schema if f.name not in kinds}
        for whole in batches:
            kinds[ROW] = whole.column(0).type
            for b in slices(whole, "text", slice_bytes):
                got = aligner.batch(b.column(1).to_pylist())
                pair = pa.array(got["pair"].astype(np.int32))
                offsets = pa.array(np.searchsorted(got["of"], np.arange(len(b) + 1)).astype(np.int32))
                yield record(len(b), part=pa.array(np.zeros(len(b), np.int32)), groups_sha256=pa.array(got["sha"], pa.string()),
                             pairs=pa.ListArray.from_arrays(offsets, pair), **{ROW: b.column(0)},
                             **{f.name: pa.array(got[f.name]) for f in counts})
                counted = pa.table({"pair": pair}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
                partial.append(counted.rename_columns(["pair", "n"]))
                if sum(map(len, partial)) > 1_000_000:
                    partial = [added(partial)]
        if partial:
            for b in added(partial).combine_chunks().to_batches():
                yield record(len(b), part=pa.array(np.ones(len(b), np.int32)), pair=b.column("pair"), n=b.column("n"))

    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/align-{uuid.uuid4()}"
    rows.mapInArrow(encode, schema).write.parquet(folder)
    written = spark.read.schema(schema).parquet(folder)
    # At most one row for each possible pair of the two vocabularies comes to the driver.
    total = written.filter("part = 1").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    aligner = Aligner(a_path, b_path)
    count = np.zeros(len(aligner.universe), np.int64)
    count[total["pair"].to_numpy(np.int64)] = total["n"].to_numpy(np.int64)
    b_id = aligner.universe % aligner.width
    highest = np.zeros(aligner.width, np.int64)
    np.maximum.at(highest, b_id, count)
    table = spark.sparkContext.broadcast((count, count == highest[b_id]))

    def look_up(batches: Iterator) -> Iterator:
        import pyarrow as pa

        count, best = table.value
        for whole in batches:
            links = whole.column("pairs").value_lengths().to_numpy(zero_copy_only=False)
            for lo, hi in cuts(links.tolist(), slice_bytes):
                b = whole.slice(lo, hi - lo)
                at = b.column("pairs").flatten().to_numpy()
                ends = np.concatenate([[0], np.cumsum(links[lo:hi])]).astype(np.int64)
                sums = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[ends]))
                out = {c: b.column(c) for c in (ROW, "n_a", "n_b", "n_groups", "n_links")}
                out |= {"n_best": sums(best[at]), "count_sum": sums(count[at]), "groups_sha256": b.column("groups_sha256")}
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    result = T.StructType([schema[ROW], *counts, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()),
                           schema["groups_sha256"]])
    return written.filter("part = 0").select(ROW, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs") \
        .mapInArrow(look_up, result)
