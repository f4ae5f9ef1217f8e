from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from peerglass.llm.chat import DEFAULT, Marks, Template, digest_conversations, format_conversations

SCHEMA = "conv_id long, turn long, role string, text string, segments string"


def test_formats_and_reads_back(spark):
    rows = [
        (1, 1, "assistant", "</s>[INST] ok [/INST]", "x"), (1, 0, "user", "a\\", None),
        (2, 0, "assistant", None, None), (2, 1, "tool", "[/ROLE]", None), (2, 2, None, "é", None),
        (3, 0, "system", "s", None), (3, 1, "user", "", None), (3, 2, "assistant", "y" * 50_000, None),
        (None, 0, "user", "q", None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: r for r in digest_conversations(format_conversations(df)).collect()}
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in turns))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), sha(said))
    assert [got[c].well_formed for c in (1, 2, 3, None)] == [True, False, True, False]
    flat = "".join(s.text for r in format_conversations(df.where("conv_id = 1")).collect() for s in r.segments)
    assert flat == "[INST]a\\\\[/INST]<s><\\/s>[\\INST] ok [\\/INST]</s>"
    assert got[1].formatted_chars == len(flat)
    assert digest_conversations(format_conversations(df.limit(0))).count() == 0


def test_ties_and_repeats(spark):
    df = spark.createDataFrame([(1, 0, "user", "b", None), (1, 0, "user", "a", None)] * 2, SCHEMA)
    rows = format_conversations(df).orderBy("turn_no").collect()
    assert [r.segments[1].text for r in rows] == ["a", "a", "b", "b"]
    assert [r.expected for r in rows] == [True, False, False, False]


@settings(max_examples=200, deadline=None)
@given(
    st.sampled_from(["user", "assistant", "system", "x", "", "[/ROLE]\\"]),
    st.lists(st.sampled_from(["[INST]", "</s>", "\\", "<", "s>", "[/TURN]", "é\n", "<\\/s>"])).map("".join),
)
def test_escape_is_reversible(role, text):
    parts = DEFAULT.segments(role, text)
    assert DEFAULT.parse_turn("".join(t for t, _ in parts)) == (role, text)
    assert not any(m in DEFAULT.escaped(text) for m in DEFAULT.control)


def test_ambiguous_template():
    with pytest.raises(ValueError):
        Template({"a": Marks("[A", "]]"), "b": Marks("[AB", "]]")}, ("{{", "||", "}}"), {})
    with pytest.raises(ValueError):
        Template({"a": Marks("<a><", "<b>")}, ("{{", "||", "}}"), {})
