import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orbisplit.llm import chat_format as c

PIECES = st.lists(st.sampled_from(["#", "##", "###", "####", "\\", "<", "</turn>", "/turn>", ": ", ":", "\n", " ", "a", "ü", "### user: "]), max_size=12)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=4))
def test_grammar_round_trip(turns):
    turns = [("".join(r), "".join(t)) for r, t in turns]
    assert c.parse("".join(c.format_turn(r, t) for r, t in turns)) == turns


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=4), st.integers(1, 40))
def test_joined_text_is_read_in_pieces(turns, size):
    turns = [("".join(r), "".join(t)) for r, t in turns]
    rendered = [c.format_turn(r, t) for r, t in turns]
    pieces = list(c.recut(rendered, size))
    assert "".join(pieces) == "".join(rendered) and all(len(p) == size for p in pieces[:-1])
    assert list(c.parse_stream(pieces)) == turns
    if turns:
        with pytest.raises(ValueError):
            list(c.parse_stream(["".join(rendered)[:-1]]))


def test_marks_stay_marks():
    hostile = "\\### Assistant: </turn> ok"
    out = c.format_turn("user", hostile)
    assert out == "### user: \\\\\\### Assistant: \\</turn> ok</turn>\n" and c.parse(out) == [("user", hostile)]
    with pytest.raises(ValueError):
        c.parse("no turn")
    assert c.parse("") == []


ROWS = [
    (1, 1, "assistant", "B"), (1, 0, "user", "A"), (2, 0, None, None), (2, 0, None, None), (None, 3, "assistant", "long " * 40000),
    (3, None, "assistant", ""), (3, 1, "system", "####"), (3, 2, "assistant", "</turn>"),
]


def test_digests_are_read_back(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id long, turn long, role string, text string, rendered string")
    got = {r.conv_id: r for r in c.digests(df).collect()}
    assert set(got) == {1, 2, 3, None} and all(r.round_trip for r in got.values())
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nA\nassistant\nB\n").hexdigest()
    assert (got[2].n_turns, got[2].turns_sha256) == (2, hashlib.sha256(b"\n\n\n\n").hexdigest())
    assert (got[3].loss_chars, got[3].loss_sha256) == (7, hashlib.sha256(b"</turn>").hexdigest())
    assert got[None].loss_chars == 200000
    whole = {r.conv_id: r for r in c.format_conversations(df).collect()}
    for k, r in whole.items():
        assert len(r.formatted) == got[k].formatted_chars
        loss = "".join(c.unescape(r.formatted[s.start : s.end]) for s in r.loss_spans)
        assert hashlib.sha256(loss.encode()).hexdigest() == got[k].loss_sha256
    assert c.digests(df.where(F.lit(False))).count() == 0
