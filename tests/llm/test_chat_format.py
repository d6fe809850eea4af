from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm import chat_format as cf

TEXT = st.lists(st.sampled_from(["#", "###", "### user: ", "</turn>", "</turn>\n", "<", "\\", "\\\\", "a", "\n", "é", " "]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "to ol:\\", "é\n"]), TEXT), max_size=6))
def test_round_trip(turns):
    out, spans, rounds = cf.format_turns(turns)
    back = cf.parse(out)
    assert [t[:2] for t in back] == turns and [t[2:] for t in back] == spans and rounds <= 2


def test_plain_texts_stay_raw_and_conflicts_are_escaped():
    out, _, rounds = cf.format_turns([("user", "C:\\x <b>"), ("assistant", "</turn>")])
    assert out == "### user: C:\\x <b></turn>\n### assistant\\: \\</turn></turn>\n" and rounds == 2


@pytest.mark.parametrize("bad", ["x", "### user: a", "### user: a</turn>", "### user: a ### b</turn>\n"])
def test_grammar_errors(bad):
    with pytest.raises(cf.GrammarError):
        cf.parse(bad)


def test_conversations_against_brute_force(spark):
    rows = [(1, 1, "assistant", "B"), (1, 0, "user", "a ###"), (2, 0, "assistant", None), (2, 0, "assistant", "x" * 50_000), (3, 0, None, "</turn>"), (None, 0, "user", ""), (4, 0, "user", "q"), (4, 0, "user", "q"), (4, None, "assistant", "né")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in cf.read_back(cf.format_conversations(df)).collect()}
    assert len(got) == 5
    for key, r in got.items():
        own = sorted((x for x in rows if x[0] == key), key=lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, x[3] or ""))
        said = "".join(t or "" for _, _, role, t in own if role == "assistant")
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == sha256("".join(f"{a or ''}\n{t or ''}\n" for _, _, a, t in own).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), sha256(said.encode()).hexdigest())
    assert cf.format_conversations(df.limit(0)).count() == 0
