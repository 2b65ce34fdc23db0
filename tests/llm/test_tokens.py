import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from campaignlab.llm.tokens import TokenCounter, token_counts
from tokenizers import Tokenizer

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return lambda x: len(t.encode(x, add_special_tokens=False))


def test_small_chunks_equal_one_call(texts, whole):
    for chunk, overlap in ((64, 8), (200, 16), (2048, 64), (8192, 256)):
        got = TokenCounter(PATH, chunk, overlap).count([t[:5000] for _, t in texts[:60]])
        assert got == [whole(t[:5000]) for _, t in texts[:60]]


HARD = ["漢字" * 300, "a1" * 300, "12345" * 100, "x" * 700, "<|endoftext|>" * 40 + " <|startoftext|>", "é " * 200,
        "it's we'll 've" * 60, "Σας ΣΑΣ " * 60, "  a\x1cb\x85c " * 60, "!?" * 400 + "é9é", "İI " * 100,
        "a\x0bb\x0cc \x0b\x0c 'll\x0b's\x0c\u0301e " * 60, "\u00a0x\u2003y\u3000\u1680z " * 60]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text, whole):
    for chunk, overlap in ((32, 4), (100, 10)):
        assert TokenCounter(PATH, chunk, overlap).count([text]) == [whole(text)]


@pytest.mark.parametrize("text", ["", " ", "\x0b\x0c", *HARD])
def test_short_texts_by_their_pieces(text, whole):
    c = TokenCounter(PATH, 32, 4, huge=100_000)
    assert c.count([text, "", text + " tail"]) == [whole(text), 0, whole(text + " tail")]
    assert c.count([text]) == [whole(text)]  # from memory
    assert c.widened == 0


def test_memory_is_bound(texts, whole):
    c = TokenCounter(PATH, huge=100_000, memory=50)
    for _, t in texts[:20]:
        assert c.count([t[:3000]]) == [whole(t[:3000])]
        assert len(c.known) <= 50 + len(set(t[:3000].split()))


def test_overlap_widens_where_nothing_is_stable():
    c = TokenCounter(PATH, 32, 4)
    c.count(["x" * 500 + " tail end"])
    assert c.widened > 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab1 2'\n\t<|>éÉ́漢!stendofx", max_size=200))
def test_random_texts(text):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    assert TokenCounter(PATH, 16, 4).count([text]) == [len(t.encode(text, add_special_tokens=False))]


def test_table(make, odd, whole):
    rows = token_counts(make(odd), PATH, limit=100).select("__row.doc_id", "__row.text", "n_bytes", "n_tokens", "over_limit")
    got = rows.collect()
    assert len(got) == len(odd)
    for r in got:
        t = r["text"] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), whole(t))
        assert r["over_limit"] == (r["n_tokens"] > 100)
    assert token_counts(make([]), PATH).count() == 0
