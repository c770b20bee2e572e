import hashlib
import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

import __spark_entry__ as entry
from fleetlens.llm import chat_format as chat
from tests.oracle_check import compare, connect

DATA = "/root/testdata/sf0.001"
LAYOUTS = {
    "messages": {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]},
    "shared_chats": {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
    "instruction": {"instruction": "hi", "output": "yo", "input": ""},
    "prompt_completion": {"prompt": "hi", "completion": "yo"},
    "question_answer": {"question": "hi", "answer": "yo"},
    "nested_dialogue": {"data": {"dialogue": [{"speaker": "human", "utterance": "hi"}, {"speaker": "bot", "utterance": "yo"}]}},
}


def test_query_equals_sql(spark):
    assert compare(entry.queries()["op2_chat_formatting"](spark, DATA), connect(DATA), entry.oracle_sql()["op2_chat_formatting"]) is None


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts_give_the_same_turns(spark, name):
    row = chat.format_chats(spark.createDataFrame([(1, json.dumps(LAYOUTS[name]))], "id long, record string"), "id", "record").first()
    assert row["mapping"] == name and chat.read_back(row["formatted"]) == [("user", "hi"), ("assistant", "yo")]
    (span,) = row["loss_spans"]
    assert row["formatted"][span["start"]:span["start"] + span["length"]] == "yo"


def test_history_and_system():
    record = {"instruction": "c", "output": "d", "history": [["a", "b"]], "system": "s"}
    mapping = chat.mapping_table()[chat.fingerprint(chat.field_paths(record))]
    assert chat.turns_of(record, mapping) == [("system", "s"), ("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]


def test_odd_records(spark):
    rows = [(1, None), (2, ""), (3, "not json"), (4, "[1]"), (5, '{"other": 1}'), (6, '{"messages": []}'), (None, '{"prompt": null, "completion": "x"}'), (7, '{"prompt": "\\ud800", "completion": 5}')]
    got = {r["id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "id long, record string"), "id", "record").collect()}
    assert [got[i]["n_turns"] for i in (1, 2, 3, 4, 5, 6)] == [0] * 6 and got[5]["fingerprint"] and got[5]["mapping"] is None
    assert chat.read_back(got[None]["formatted"]) == [("user", ""), ("assistant", "x")]
    assert chat.read_back(got[7]["formatted"])[1] == ("assistant", "5")


def test_rows_by_turn_with_nulls_and_ties(spark):
    rows = [(1, None, "user", None), (1, 1, None, "b"), (1, 1, "assistant", "a"), (None, 0, "user", "x" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'y' record", "1 messages")
    got = {r["conv_id"]: chat.read_back(r["formatted"]) for r in chat.format_chats(chat.records_of_turns(df), "conv_id", "record").collect()}
    assert got == {1: [("user", ""), ("", "b"), ("assistant", "a")], None: [("user", "x" * 100_000)]}
    assert chat.digests(chat.format_chats(chat.records_of_turns(df.limit(0)), "conv_id", "record"), "conv_id").count() == 0


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "</s>"]), st.text(alphabet=st.sampled_from("<[]/\\>sINTROLE x"), max_size=30) | st.sampled_from(["</s>", "<\\s>", "[/ROLE]", "[\\\\INST]"])), max_size=6))
def test_reading_gives_what_was_rendered(turns):
    text, spans = chat.render(turns)
    assert chat.read_back(text) == turns and text.count("</s>") == len(turns)
    assert "".join(chat.unescape(text[s["start"]:s["start"] + s["length"]]) for s in spans) == "".join(t for r, t in turns if r == "assistant")
    assert hashlib.sha256(text.encode()).hexdigest()


def test_deep_and_odd_records_have_no_turns(spark):
    deep = '{"messages": ' + "[" * 100_000 + "]" * 100_000 + "}"
    good = json.dumps({"messages": [{"role": "user", "content": "hi"}]})
    rows = [(1, deep), (2, '{"a": ' * 3000 + "1" + "}" * 3000), (3, '{"\\ud800": 1}'), (4, '{"messages": "hello"}'), (5, '{"messages": []}'), (6, good), (6, good), (7, "[" * 100_000), (8, None)]
    got = chat.format_chats(spark.createDataFrame(rows, "k long, record string"), "k", "record").collect()
    found = sorted((r["k"], r["mapping"], r["n_turns"]) for r in got if r["mapping"])
    assert found == [(5, "no_messages", 0), (6, "messages", 1), (6, "messages", 1)]
    assert len(got) == len(rows) and all(r["formatted"] == "" for r in got if r["k"] != 6)
