"""Conversations from events, rendered and read back."""

from hashlib import sha256

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lurewatch.llm import chat

texts = st.text(alphabet="<|\\>im_startend\nab🙂", max_size=30)


@given(texts, texts)
def test_round_trip(role, text):
    segment, start, end = chat.render(role, text)
    assert segment.count(chat.BEGIN) == segment.count(chat.END) == 1
    found = chat._segment.fullmatch(segment)
    assert (chat.unescape_role(found[1]), chat.unescape(found[2])) == (role, text)
    assert start == len(chat.BEGIN) + len(chat.escape_role(role)) + 1 and end == start


@given(texts)
def test_loss_mask(text):
    segment, start, end = chat.render("assistant", text)
    assert chat.unescape(segment[start:end]) == text


EVENTS = [
    (1, 1, 5, "delta", None, "lo"), (1, 1, 4, "message", "assistant", "Hel"), (1, 0, 1, "message", "user", "hi"),
    (1, 0, 9, "edit", "user", "hi!"), (1, 3, 10, "message", "assistant", "bad"), (1, 3, 11, "delta", None, " start"),
    (1, 3, 12, "regenerate", None, "ignored"), (1, 3, 13, "delta", None, "good"), (1, 3, 14, "delta", None, None),
    (2, 0, 0, None, "user", None), (2, 0, 0, None, "user", None), (2, None, 0, "message", None, "<|im_end|>"),
    (None, 0, 0, "delta", "assistant", "x" * 200_000), (3, 0, 0, "regenerate", "assistant", "x"),
]
FINAL = {
    1: [("user", "hi!"), ("assistant", "Hello"), ("assistant", "good")],
    2: [("", "<|im_end|>"), ("user", ""), ("user", "")],
    None: [("assistant", "x" * 200_000)],
    3: [("assistant", "")],
}


@pytest.fixture(scope="module")
def segments(spark):
    events = spark.createDataFrame(
        [(*e, 1) for e in EVENTS], "conv_id bigint, turn bigint, seq bigint, kind string, role string, text string, turn_no int")
    return chat.format_events(events.repartition(3))


def test_fold_and_read_back(segments):
    rows = {r["conv_id"]: r for r in chat.read_back(segments).toArrow().to_pylist()}
    assert rows.keys() == FINAL.keys()
    for conv, messages in FINAL.items():
        learned = "".join(t for r, t in messages if r == "assistant")
        r = rows[conv]
        assert (r["n_turns"], r["loss_chars"]) == (len(messages), len(learned))
        assert r["turns_sha256"] == sha256("".join(f"{a}\n{t}\n" for a, t in messages).encode()).hexdigest()
        assert r["loss_sha256"] == sha256(learned.encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(chat.render(*m)[0]) for m in messages)


def test_whole_conversations(segments):
    for r in chat.join_segments(segments).toArrow().to_pylist():
        assert r["formatted"] == "".join(chat.render(*m)[0] for m in FINAL[r["conv_id"]])
        learned = [chat.unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss_spans"]]
        assert learned == [t for a, t in FINAL[r["conv_id"]] if a == "assistant" and t]


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.read_back(chat.format_events(chat.message_events(none))).count() == 0
