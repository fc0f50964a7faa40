import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = [*chat.INST.controls(), "[", "]", "<", ">", "\\", "/", "INST", "s>", " ", "\n", "é", "😀", "\0", "$1", "a"]


def rows_of(spark, chats):
    return spark.createDataFrame([(c, t, role, text) for c, turns in chats.items() for t, (role, text) in enumerate(turns)], SCHEMA)


def read(df):
    out = chat.formatted_chats(df)
    turns = chat.read_back(F.col("formatted"))
    return {r["conv_id"]: r for r in out.withColumns({"turns": turns, "lost": chat.loss_text(F.col("segments"))}).collect()}


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "[SAID]", "a\\"]), st.lists(st.sampled_from(PIECES), max_size=8).map("".join)), min_size=1, max_size=6), min_size=1, max_size=12))
def test_round_trip(spark, chats):
    chats = dict(enumerate(chats))
    got = read(rows_of(spark, chats))
    for c, turns in chats.items():
        r = got[c]
        assert [tuple(t) for t in r["turns"]] == turns
        assert r["n_turns"] == len(turns)
        assert r["lost"] == "".join(t for role, t in turns if role == "assistant")
        assert r["formatted"] == "".join(s["text"] for s in r["segments"])
        # control strings stand only where the template put them
        known = sum(2 if role in chat.INST.roles else 3 for role, _ in turns)
        assert sum(r["formatted"].count(x) for x in chat.INST.controls()) == known


def test_machine(spark):
    a, u, s = ("assistant", "x"), ("user", "x"), ("system", "x")
    chats = {1: [u, a], 2: [s, u, a, u, a], 3: [a, u], 4: [u, a, a, u], 5: [u, a, u], 6: [s], 7: [u, ("tool", "x"), a], 8: [u, s, a]}
    got = read(rows_of(spark, chats))
    assert {c: r["error_turn"] for c, r in got.items()} == {1: None, 2: None, 3: 0, 4: 2, 5: 3, 6: 1, 7: 1, 8: 1}
    assert all(r["valid"] == (r["error_turn"] is None) for r in got.values())


def test_nulls_ties_repeats_and_long_texts(spark):
    long = "[INST] \\" * 200_000
    rows = [(1, 2, "user", long), (1, None, "user", "b"), (1, None, "user", "a"), (1, 2, None, None), (1, 2, "user", long), (None, 0, "assistant", "z"), (None, 0, "user", "y")]
    got = read(spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("clash"), "formatted": F.lit(1), "segments": F.lit(2)}))
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "a"), ("user", "b"), ("", ""), ("user", long), ("user", long)]
    assert [tuple(t) for t in got[None]["turns"]] == [("assistant", "z"), ("user", "y")]
    assert read(spark.createDataFrame([], SCHEMA)) == {}


def test_templates_that_cannot_be_told_apart():
    for open, close in (("<a>", "<a>b"), ("a", "<b>"), ("<a<", "<b>"), ("<a b>", "<b>"), ("<\\a>", "<b>"), ("<a>", "<a>")):
        with pytest.raises(ValueError):
            chat.Template(roles={"user": chat.Turn(open, close)}, moves={})


def test_own_template(spark):
    own = chat.Template(roles={"user": chat.Turn("<|user|>\n", "<|end|>"), "assistant": chat.Turn("<|bot|>", "<|eot|>", True)}, moves={("start", "user"): "u"}, accepting=frozenset({"u"}))
    out = chat.formatted_chats(rows_of(spark, {1: [("user", "<|end|>")]}), template=own).first()
    assert out["formatted"] == "<|user|>\n<\\|end|><|end|>" and out["valid"]


def test_no_python_in_the_plan(spark):
    from tidemill.llm.queries import op12_chat_format

    plan = op12_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
