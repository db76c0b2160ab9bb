from __future__ import annotations

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricetide.llm import chat
from pricetide.llm.catalog import op7_chat
from pricetide.llm.common import read

MARKS = st.text(st.sampled_from(list("\\<[lbe/s>INST] é\n")), max_size=12)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_reads_back_what_went_in(spark):
    rows = read(spark, "/root/testdata/sf0.01", "conversations").collect()
    by_id = {-1: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in rows:
        by_id.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    found = {r.conv_id: r for r in op7_chat(spark, "/root/testdata/sf0.01").collect()}
    assert found.keys() == by_id.keys()
    for key, turns in by_id.items():
        turns.sort()
        learnt = "".join(t for _, role, t in turns if role == "assistant")
        row = found[key]
        assert row.n_turns == len(turns)
        assert row.turns_sha256 == sha("".join(f"{role}\n{t}\n" for _, role, t in turns))
        assert (row.loss_chars, row.loss_sha256) == (len(learnt), sha(learnt))
        marks = sum(len("<s>[INST]  [/INST]</s>") + len(role) for _, role, _ in turns)
        assert row.formatted_chars == marks + sum(len(t) + sum(map(t.count, "\\<[")) for _, _, t in turns)


def test_query_keeps_the_conversation_without_an_id(spark, tmp_path):
    rows = [(None, 0, "user", "q"), (None, 1, "assistant", "aa"), (7, 0, "user", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.conv_id: (r.n_turns, r.loss_chars) for r in op7_chat(spark, str(tmp_path)).collect()}
    assert found == {None: (2, 2), 7: (1, 0), -1: (2, len("</s>[INST] ok [/INST]"))}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), MARKS), MARKS), min_size=1, max_size=6))
def test_round_trip(spark, turns):
    frame = spark.createDataFrame([(1, i, *t) for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    texts = chat.formatted(frame)
    back = chat.read_back(texts).first()
    assert [tuple(t) for t in back.turns] == turns
    assert back.loss_text == "".join(t for role, t in turns if role == "assistant")
    whole = texts.first()
    assert whole.formatted.count("</s>") == whole.formatted.count("[INST] ") == len(turns)


LAYOUTS = {
    "messages array<struct<role: string, content: string>>": [("system", "s"), ("user", "q"), ("assistant", "a")],
    "conversations array<struct<from: string, value: string>>": [("human", "q"), ("gpt", "a")],
}


@pytest.mark.parametrize("schema", LAYOUTS)
def test_array_layouts(spark, schema):
    turns = LAYOUTS[schema]
    frame = spark.createDataFrame([(1, turns, "x"), (2, None, "y"), (3, [], None)], f"id long, {schema}, turns string")
    found = sorted(tuple(r) for r in chat.canonical_turns(frame, "id").collect())
    names = {"human": "user", "gpt": "assistant"}
    assert found == [(1, i, names.get(role, role), text) for i, (role, text) in enumerate(turns)]


def test_field_layouts_and_unknown_fields(spark):
    frame = spark.createDataFrame([(1, "do", "with", "done"), (2, "do", None, None)], "id long, instruction string, input string, output string")
    found = [tuple(r)[:4] for r in chat.canonical_turns(frame, "id").orderBy("conv_id", "turn").collect()]
    assert found == [(1, 0, "user", "do\n\nwith"), (1, 1, "assistant", "done"), (2, 0, "user", "do"), (2, 1, "assistant", "")]
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical_turns(frame.select("id", "instruction"), "id")


def test_json_rows_of_different_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "source": 1},
        {"prompt": "q", "completion": "a"},
        {"prompt": "q", "response": "a", "score": 0.5},
        {"instruction": "q", "output": "a"},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"something": "else"},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(6, "{broken"), (7, None)]
    frame = spark.createDataFrame(rows, "id long, layout string")
    found = {}
    for row in chat.canonical_json(frame, "id", "layout").collect():
        found.setdefault(row.conv_id, []).append((row.turn, row.role, row.text))
    for i in range(5):
        assert sorted(found[i]) == [(0, "user", "q"), (1, "assistant", "a")]
    assert [found[i] for i in (5, 6, 7)] == [[(None, None, None)]] * 3


def test_edges(spark):
    rows = [(1, 0, None, None, "x"), (1, 0, None, None, "x"), (None, 1, "assistant", "a", "x"), (None, None, "user", "q", "x"),
            (2, 0, "assistant", "b" * 100_000, "x"), (2, 1, "assistant", "\\e<", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    back = {r.conv_id: r for r in chat.read_back(chat.formatted(chat.canonical_turns(frame, "conv_id"))).collect()}
    assert [tuple(t) for t in back[1].turns] == [("", ""), ("", "")] and back[1].loss_text == ""
    assert [tuple(t) for t in back[None].turns] == [("user", "q"), ("assistant", "a")]
    assert back[2].loss_text == "b" * 100_000 + "\\e<"
    assert chat.formatted(frame.limit(0)).count() == 0


def test_scan_stays_in_the_jvm(spark):
    frame = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.read_back(chat.formatted(frame)).select(F.size("turns"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
