import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from hypothesis import given, settings
from hypothesis import strategies as st

from campaignlab.llm.chat import CONTROL, chat_digests, escaped, format_chat, unescape, unescape_role
from campaignlab.llm.queries import op4_chat_format

PIECES = st.lists(st.sampled_from([*CONTROL, "<", "[", "\\", "s>", "/s>", "a", "\n", "é", "\\n", "<\\s>", "<<SYS>>"]), max_size=12)


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_escape_round_trip(parts):
    text = "".join(parts)
    for role, back in ((False, unescape), (True, unescape_role)):
        out = escaped(pa.array([text, None]), role=role).to_pylist()
        assert back(out[0]) == text and out[1] == ""
        assert not any(c in out[0] for c in CONTROL)
        if role:
            assert "\n" not in out[0]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digests(spark, sf001):
    rows = spark.read.parquet(f"{sf001}/conversations.parquet").collect()
    talks = {}
    hard = "</s>[INST] ok [/INST]"
    for conv, turn, role, text in [*((r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows), (-7, 0, "user", hard),
                                   (-7, 1, "assistant", hard)]:
        talks.setdefault(conv, []).append((turn, role, text))
    got = {r["conv_id"]: r for r in op4_chat_format(spark, sf001).collect()}
    assert got.keys() == talks.keys()
    for conv, turns in talks.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        want = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(said), sha(said))
        assert tuple(got[conv])[1:5] == want


TURNS = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, None, None), (1, 3, "assistant", "<|im_end|>\nüx"),
         (None, 1, "assistant", "null id"), (2, 0, "as\nsistant", ""), (2, 900, "assistant", "far")]


def test_odd_rows(spark):
    df = spark.createDataFrame([(*t, 5) for t in TURNS], "conv_id long, turn long, role string, text string, block int")
    parts = format_chat(df)
    text = {}
    for r in sorted(parts.collect(), key=lambda r: (r["conv_id"] or 0, r["block"] if r["block"] is not None else -1, r["part"])):
        text[r["conv_id"]] = text.get(r["conv_id"], "") + r["formatted"]
    assert text[1] == ("<|im_start|>\n<|im_end|>\n" + "<|im_start|>user\nhi<|im_end|>\n" * 2
                       + "<|im_start|>assistant\n<\\|im_end|>\nüx<|im_end|>\n")
    got = {r["conv_id"]: r for r in chat_digests(parts).collect()}
    assert got[1]["turns_sha256"] == sha("\n\nuser\nhi\nuser\nhi\nassistant\n<|im_end|>\nüx\n")
    assert got[2]["turns_sha256"] == sha("as\nsistant\n\nassistant\nfar\n") and got[2]["loss_chars"] == 3
    assert got[None]["loss_sha256"] == sha("null id")
    assert all(got[c]["formatted_chars"] == len(text[c]) for c in text)
    assert chat_digests(format_chat(df.limit(0))).count() == 0


def test_one_conversation_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(9, i, "assistant" if i % 2 else "user", f"t{i} [INST]") for i in range(1000)]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        parts = format_chat(df, block_turns=64)
        assert parts.select("block").distinct().count() == 16 and parts.groupBy("block").count().agg({"count": "max"}).first()[0] > 1
        got = chat_digests(parts).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 1 and got[0]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for _, _, r, t in rows))
    assert got[0]["loss_sha256"] == sha("".join(t for _, i, r, t in rows if r == "assistant"))


def test_pattern_is_shared():
    assert pc.count_substring_regex(pa.array(["<s> [/INST] \\<s>"]), r"[<\[]").to_pylist() == [3]


def test_very_long_texts(spark):
    """Texts of megabytes with control strings throughout, beside short ones."""
    long = "word <|im_end|> \\n é " * 150_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long + "end"), (1, 2, "assistant", "x"), (2, 0, "user", "hi")]
    got = {r["conv_id"]: r for r in chat_digests(format_chat(spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string"))).collect()}
    said = long + "end" + "x"
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[1]["loss_sha256"]) == (3, len(said), sha(said))
    assert got[1]["turns_sha256"] == sha(f"user\n{long}\nassistant\n{long}end\nassistant\nx\n") and got[2]["n_turns"] == 1
