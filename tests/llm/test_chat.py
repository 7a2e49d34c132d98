import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixloom.llm.chat import escape, format_conversations, parse, read_back, unescape

TEXT = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "<", "[", "\\", "/s>", "s>", "]", " ", "é", "INST]", "x\n"]), max_size=8).map("".join)


@settings(max_examples=500, deadline=None)
@given(TEXT)
def test_escaping_is_reversible_and_hides_marks(text):
    hidden = escape(pa.array([text])).to_pylist()[0]
    assert unescape(hidden) == text
    assert not any(m in hidden for m in ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"))


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, (r[3] or "").encode()))
        said = [(r[2] or "", r[3] or "") for r in turns]
        loss = "".join(t for role, t in said if role == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(said), digest("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), digest(loss))
    return out


ROWS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
ROWS += [(i, t, ["user", "assistant", "system", None, "[/ROLE]", ""][(i + t) % 6], ["é" * (i % 7), "<\\s> [\\\\INST]", None, "", "[", "a\nb"][(i * 3 + t) % 6]) for i in range(60) for t in range(i % 9 + 1)]
ROWS += [(500, i, "user" if i % 2 else "assistant", f"turn {i} </s>") for i in range(700)]
ROWS += [(501, 0, "assistant", "ß long " * 30_000), (None, 1, "user", "x"), (None, 0, "assistant", "y"), (502, 3, "user", "same"), (502, 3, "user", "same"), (503, None, "assistant", "n")]


@pytest.mark.parametrize("piece", [8192, 50])
def test_round_trip(spark, piece):
    table = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "conv_id long, turn long, role string, text string, formatted string, piece int")
    made = format_conversations(table.repartition(5), piece_turns=piece)
    got = {r.conv_id: r for r in read_back(made).collect()}
    want = brute(ROWS)
    assert set(got) == set(want)
    for conv, w in want.items():
        assert tuple(got[conv])[1:5] == w, conv
    rows = made.collect()
    assert {r.conv_id: sum(x.n_turns for x in rows if x.conv_id == r.conv_id) for r in rows} == {c: w[0] for c, w in want.items()}
    for c, r in got.items():
        assert r.formatted_chars == sum(len(x.formatted) for x in rows if x.conv_id == c)
    first = next(r.formatted for r in rows if r.conv_id == -1)
    assert first == r"<s>[INST] <\/s>[\INST] ok [\/INST] [/INST]<\/s>[\INST] ok [\/INST]</s>"
    assert parse(first)[1] == ("assistant", "</s>[INST] ok [/INST]")


def test_small_batches_and_empty_table(spark):
    table = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.conv_id: tuple(r)[1:5] for r in read_back(format_conversations(table, piece_turns=20)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert got == brute(ROWS)
    assert read_back(format_conversations(table.limit(0))).count() == 0
