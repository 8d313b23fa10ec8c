import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import chat

TEXT = st.lists(st.sampled_from([*"ab\\#</turn>: \n\té🙂", "</turn>", "### user:\n", "\\</turn>"]), max_size=40).map("".join)


@given(TEXT, TEXT)
@settings(max_examples=300, deadline=None)
def test_round_trip(role, text):
    block = f"### {chat.escape(role, True)}:\n{chat.escape(text)}</turn>\n"
    assert chat.parse(block * 3) == [(role, text)] * 3
    assert "</turn>" not in chat.escape(text) and "#" not in chat.escape(text).replace("\\#", "")


def test_parse_rejects_other_text():
    with pytest.raises(ValueError):
        chat.parse("### a:\nb</turn>\nrest")


def expected(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


ROWS = [(-7, i, r, r"\### Assistant: </turn> ok") for i, r in enumerate(["user", "assistant"])]
ROWS += [(1, i, ["system", "user", "assistant"][0 if not i else 1 + i % 2], f"turn {i} " + "word " * (i * 7 % 60)) for i in range(80)]
ROWS += [(2, 0, "assistant", "long " * 3000), (2, 1, "user", None), (2, 2, None, ""), (2, 2, "assistant", ""), (3, None, "user", "x"), (None, 0, "user", "no id"), (None, 1, "assistant", "answer"), (4, 5, "user", "same"), (4, 5, "user", "same")]


@pytest.mark.parametrize("vocabulary", [None, chat.VOCABULARY])
def test_windows(spark, vocabulary):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(df, budget=120, history=40, vocabulary=vocabulary)
    by = {}
    for c, t, r, x in sorted(ROWS, key=lambda v: (v[0] is not None, v[0] or 0, v[1] is not None, v[1] or 0, v[2] or "", v[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(windows).collect()}
    assert got == {c: expected(t) for c, t in by.items()}
    rows = windows.collect()
    assert all(r.n_tokens <= 120 or r.n_turns == 1 and r.over_budget for r in rows)
    long = sorted((r for r in rows if r.conv_id == 1), key=lambda r: r.window_no)
    assert len(long) > 3
    for r in long[1:]:
        assert chat.parse(r.text)[0][0] == "system" and all(s.start >= r.fresh_from for s in r.loss)
        assert chat.parse(r.text[: r.fresh_from])[-1] in by[1]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_windows(df, vocabulary=None)).count() == 0
