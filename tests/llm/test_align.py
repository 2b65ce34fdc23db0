import hashlib
from collections import Counter

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import public_tokenizers
from campaignlab.llm.align import Aligner, align_tokenizers, byte_vocabulary, pair_universe, piece_vocabulary

A, B = (str(public_tokenizers.path(f)) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ZEROS = (0, 0, 0, 0, [], "")


@pytest.fixture(scope="module")
def plain():
    """Alignment of one text from one call of each library and a loop over bytes:
    n_a, n_b, n_groups, n_links, linked id pairs, digest."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    of_a, of_b = byte_vocabulary(a), piece_vocabulary(b)

    def align(text):
        if not text:
            return ZEROS
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        want = (" " + text).encode()
        if b"".join(of_a[i] for i in x) != want or b"".join(of_b[i] for i in y) != want:
            return ZEROS
        ends = []
        for ids, of in ((x, of_a), (y, of_b)):
            at, out = 0, {}
            for k, i in enumerate(ids):
                at += len(of[i])
                out[at] = k
            ends.append(out)
        groups, links, i, j = [], [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0][e], ends[1][e]
            links.append((x[p], y[q]))
            groups.append(",".join(map(str, x[i:p + 1])) + "|" + ",".join(map(str, y[j:q + 1])))
            i, j = p + 1, q + 1
        return len(x), len(y), len(groups), len(links), links, hashlib.sha256(";".join(groups).encode()).hexdigest()

    return align


def same(aligner, texts, plain):
    got = aligner.batch(texts)
    for k, t in enumerate(texts):
        n_a, n_b, groups, links, pairs, sha = plain(t)
        assert tuple(got[c][k] for c in ("n_a", "n_b", "n_groups", "n_links", "sha")) == (n_a, n_b, groups, links, sha)
        codes = Counter(aligner.universe[got["pair"][got["of"] == k]].tolist())
        assert codes == Counter(i * aligner.width + j for i, j in pairs)


HARD = ["", None, " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n", "a\n\n  b\t c", "x▁y z", "one <|endoftext|> two</s> <s> <0x41>",
        "it's we'll 've  I'M", "漢字 かな 漢字" * 20, "é́ ß   　 x", "a\x1c b \x85 c", "\x00 a \x00", "12345 " * 30, "🙂 👩‍👩‍👧 x",
        "word " * 500, "▁", "x" * 300]


def test_hard_texts(plain):
    aligner = Aligner(A, B, piece=40)  # long texts go in pieces
    same(aligner, HARD, plain)
    same(aligner, HARD[::-1], plain)  # remembered stretches
    same(Aligner(A, B, memory=3), HARD, plain)


def test_documents(texts, plain):
    same(Aligner(A, B, piece=20_000), [t for _, t in texts], plain)


ONE = []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab1 2'\n\t<|>é漢▁s 🙂", max_size=60), max_size=4))
def test_random_texts(plain, texts):
    ONE or ONE.append(Aligner(A, B, piece=30))
    same(ONE[0], texts, plain)


def test_universe_holds_suffix_pairs_only():
    a, b = [b"x", b"ab", b"b"], [b"b", b"cab", b"y", b"b"]
    got = {divmod(c, 4) for c in pair_universe(a, b).tolist()}
    assert got == {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x.endswith(y) or y.endswith(x)}


def check(spark_rows, docs, plain):
    want = [plain(t) for _, t in docs]
    count = Counter(p for w in want for p in w[4])
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    rows = [(d, *w[:4], sum(count[p] == best[p[1]] for p in w[4]), sum(count[p] for p in w[4]), w[5])
            for (d, _), w in zip(docs, want)]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, spark_rows), key=key) == sorted(rows, key=key)


COLS = ("__row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_table(make, odd, plain):
    docs = [(d, t) for d, t, *_ in odd] + [(100 + k, t) for k, t in enumerate(HARD)]
    got = align_tokenizers(make(docs).repartition(5), A, B, slice_bytes=500).select(*COLS)
    check(got.collect(), docs, plain)
    assert align_tokenizers(make([]), A, B).count() == 0


def test_query(spark, sf001, texts, plain):
    from campaignlab.llm.queries import queries

    check(queries()["op13_align"](spark, sf001).collect(), texts, plain)
