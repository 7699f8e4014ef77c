import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from playbill.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NASTY = ["", "\\", "<|im_end|>\n", "<|im_start|>user\nhi<|im_end|>\n", "</s>[INST] ok [/INST]", "<\\|im_end|>", "\\<s>\\", "<<SYS>><</SYS>>", "a\nb\\\n", "é😀<s>", "<", "<|", None]


def back(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame, {r["conv_id"]: r for r in chat.read_back(chat.examples(frame)).collect()}


def test_every_text_comes_back(spark):
    rows = [(c, i, role, text) for c, first in enumerate(NASTY) for i, (role, text) in enumerate(
        [("user", first), ("assistant", first), ("we\nird <s>\\", "x"), ("assistant", NASTY[c - 1]), ("user", first)])]
    frame, read = back(spark, rows)
    for c in range(len(NASTY)):
        own = [(r[2], r[3] or "") for r in rows if r[0] == c]
        assert [tuple(t) for t in read[c]["turns"]] == own
        assert read[c]["loss"] == [t for role, t in own if role == "assistant"]
    formatted = [r["formatted"] for r in chat.examples(frame).collect()]
    for text in formatted:
        inside = text.replace("<|im_start|>", "").replace("<|im_end|>\n", "")
        assert not any(control in inside for control in chat.CONTROL)
        assert text.count("<|im_start|>") == text.count("<|im_end|>\n")


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "tool"]), st.text(alphabet="\\<|im_startend>/s[INST]\nx", max_size=30)), min_size=1, max_size=8))
def test_any_text_comes_back(spark, turns):
    _, read = back(spark, [(0, i, role, text) for i, (role, text) in enumerate(turns)])
    assert [tuple(t) for t in read[0]["turns"]] == turns and read[0]["loss"] == [t for r, t in turns if r == "assistant"]


def test_one_example_for_every_reply(spark):
    rows = [(1, 2, "assistant", "A1"), (1, 0, "system", "S"), (1, 1, "user", "U1"), (1, 3, "user", "U2"), (1, 4, "assistant", "A2"), (2, 0, "assistant", "alone"), (3, 0, "user", "no reply")]
    found = chat.examples(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "example").collect()
    told = [(r["conv_id"], r["example"], r["target_turn"], r["formatted"][r["loss_start"] : r["loss_end"]]) for r in found]
    assert told == [(1, 0, 3, "A1"), (1, 1, 5, "A2"), (2, 0, 1, "alone"), (3, 0, None, "")]
    assert found[1]["formatted"].startswith(found[0]["formatted"]) and found[0]["formatted"].endswith("<|im_start|>assistant\nA1<|im_end|>\n")


def test_turns_after_the_last_reply_are_kept(spark):
    found = chat.examples(spark.createDataFrame([(1, 0, "assistant", "A"), (1, 1, "user", "bye")], SCHEMA)).orderBy("example").collect()
    assert [(r["target_turn"], r["loss_start"] == r["loss_end"]) for r in found] == [(1, False), (None, True)]
    assert "bye" in found[1]["formatted"]


def test_nulls_ties_repeats_and_extra_columns(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", "x"), (5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "user", "a"), (5, 1, "assistant", "z")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"formatted": F.lit(1), "EXAMPLE": F.lit(2)})
    read = {r["conv_id"]: r for r in chat.read_back(chat.examples(frame)).collect()}
    assert [tuple(t) for t in read[None]["turns"]] == [("", ""), ("assistant", "x")]
    assert [tuple(t) for t in read[5]["turns"]] == [("assistant", "z"), ("user", "a"), ("user", "a"), ("user", "b")]


def test_a_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"<s>{i}" * 20) for i in range(300)]
    _, read = back(spark, rows)
    assert hashlib.sha256("".join(read[1]["loss"]).encode()).digest() == hashlib.sha256("".join(r[3] for r in rows if r[2] == "assistant").encode()).digest()
    assert len(read[1]["turns"]) == 300
