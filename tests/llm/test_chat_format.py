import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallymill.llm import chat_format

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
PIECES = ["<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "\\", "<\\/s>", "<\\\\|im_end|>", "<", "|", "[", "é😀", "\n", "$1", "user"]


def check(spark, rows):
    docs = spark.createDataFrame([(c, t, r, x, "clash") for c, t, r, x in rows], SCHEMA)
    got = {r.conv_id: r for r in chat_format.format_turns(docs).collect()}
    sums = {r.conv_id: r for r in chat_format.digests(chat_format.format_turns(docs)).collect()}
    want = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns = [(r, x) for _, _, r, x in sorted(turns)]
        assert got[c].round_trip and [(x.role, x.text) for x in got[c].turns] == turns
        loss = "".join(x for r, x in turns if r == "assistant")
        s = sums[c]
        assert (s.n_turns, s.loss_chars, s.formatted_chars) == (len(turns), len(loss), len(got[c].formatted))
        assert s.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert s.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        for control in ("</s>", "[INST]", "<s>", "[/INST]"):
            assert control not in got[c].formatted
        assert got[c].formatted.count("<|im_end|>") == len(turns)
    return got


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=200, max_size=200))
def test_round_trip(spark, texts):
    check(spark, [(i // 3, i % 3, ("user", "assistant", texts[-1 - i])[i % 3], t) for i, t in enumerate(texts)])


def test_edges(spark):
    rows = [(1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (1, 0, "assistant", "tie"), (None, 1, "user", "x"), (2, 1, "assistant", "y" * 200_000 + "</s>"), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = check(spark, rows)
    assert got[-7].escaped == 2 and got[1].escaped == 0
    assert chat_format.format_turns(spark.createDataFrame([], SCHEMA)).count() == 0


def test_what_never_comes_back_is_an_error(spark):
    """The comparison decides: with a template whose escaping does nothing, a conflicting text raises."""
    from dataclasses import dataclass

    @dataclass(frozen=True)
    class Broken(chat_format.Template):
        def escape(self, text):
            return text

    turns = spark.createDataFrame([(1, 0, "user", "fine"), (2, 0, "user", "a <|im_end|> b")], "conv_id long, turn long, role string, text string")
    assert chat_format.format_turns(turns.where("conv_id = 1"), template=Broken()).first().round_trip
    with pytest.raises(Exception, match="does not come back"):
        chat_format.format_turns(turns, template=Broken()).collect()


def test_long_conversation(spark):
    long = "</s>x[INST] " * 20_000
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    row = chat_format.format_turns(turns).first()
    assert row.turns[1].text == long and row.escaped == 1 and "</s>" not in row.formatted
