from __future__ import annotations

import hashlib
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadstats.llm.chat import (
    TURN_ROWS,
    Mapping,
    canonical_turns,
    chat_digest,
    escape,
    format_chat,
    schema_fingerprint,
    select_mapping,
    table_turns,
    unescape,
)

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "INST]", "a", " ")
hostile = st.lists(st.sampled_from(CONTROL), max_size=12).map("".join)


def digest(conv_id, turns):
    """What must be read back of (role, text) turns."""
    turns = [(r or "", t or "") for r, t in turns]
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    learned = "".join(t for r, t in turns if r == "assistant")
    return (
        conv_id,
        len(turns),
        hashlib.sha256(whole.encode()).hexdigest(),
        len(learned),
        hashlib.sha256(learned.encode()).hexdigest(),
    )


def found(spark, rows):
    frame = format_chat(table_turns(spark.createDataFrame(rows, TURN_ROWS)))
    return {tuple(r)[:5] for r in chat_digest(frame).collect()}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys"]) | hostile, hostile), min_size=1, max_size=5), min_size=1, max_size=8))
def test_round_trip(spark, talks):
    rows = [(i, k, r, t) for i, turns in enumerate(talks) for k, (r, t) in enumerate(turns)]
    assert found(spark, rows) == {digest(i, turns) for i, turns in enumerate(talks)}


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(hostile, min_size=1, max_size=30))
def test_no_control_string_is_left(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in frame.select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect():
        assert r["u"] == r["t"]
        assert not any(c in r["e"] for c in CONTROL[:4])


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", None),
        (1, 1, None, "no role"),
        (2, None, "user", "last"),
        (2, 5, "assistant", "first"),
        (3, 0, "user", "same"),
        (3, 0, "user", "same"),
        (3, 0, "assistant", "tie"),
        (None, 0, "user", "no id"),
        (4, 0, "assistant", "long " * 50_000),
        *[(5, k, "user" if k % 2 else "assistant", f"turn {k}") for k in range(3000)],
    ]
    assert found(spark, rows) == {
        digest(1, [("user", ""), ("", "no role")]),
        digest(2, [("assistant", "first"), ("user", "last")]),
        digest(3, [("assistant", "tie"), ("user", "same"), ("user", "same")]),
        digest(None, [("user", "no id")]),
        digest(4, [("assistant", "long " * 50_000)]),
        digest(5, [("user" if k % 2 else "assistant", f"turn {k}") for k in range(3000)]),
    }


def test_segments_make_the_text(spark):
    frame = format_chat(table_turns(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b</s>")], TURN_ROWS)))
    row = frame.first()
    assert "".join(s["text"] for s in row["segments"]) == row["formatted"]
    assert row["formatted"] == "<s>[INST]user[/INST]a</s><s>[INST]assistant[/INST]b<\\/s></s>"
    assert [s["text"] for s in row["segments"] if s["loss"]] == ["b<\\/s>"]


def test_clashing_and_other_columns(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a", "x")], TURN_ROWS + ", formatted string")
    assert table_turns(frame).columns == ["conv_id", "turns"]
    talks = table_turns(frame).withColumn("formatted", F.lit("own"))
    assert format_chat(talks).first()["formatted"] != "own"


def test_empty_table(spark):
    assert found(spark, spark.createDataFrame([], TURN_ROWS).collect()) == set()


def test_layouts(spark):
    records = {
        "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        "conversations": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        "turns": {"turns": [{"text": "q", "role": "user"}, {"role": "assistant", "text": "a"}]},
        "instruction": {"output": "a", "input": "", "instruction": "q"},
        "instruction_only": {"output": "a", "instruction": "q"},
        "prompt": {"prompt": "q", "response": "a"},
        "question": {"question": "q", "answer": "a"},
    }
    rows = [(name, json.dumps(r)) for name, r in records.items()]
    rows += [(None, '{"prompt": "q"}'), (None, "no json"), (None, None), (None, "[1]"), (None, '{"messages": ["q"]}')]
    for r in canonical_turns(spark.createDataFrame(rows, "name string, record string"), "record").collect():
        assert r["layout"] == r["name"]
        turns = r["turns"] and [tuple(t) for t in r["turns"]]
        assert turns == ([("user", "q"), ("assistant", "a")] if r["name"] else None)


def converted(spark, *records):
    frame = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "i int, record string")
    rows = canonical_turns(frame, "record").orderBy("i").collect()
    return [(r["layout"], r["turns"] if r["turns"] is None else [tuple(t) for t in r["turns"]]) for r in rows]


def test_other_fields_empty_arrays_and_mixed_texts(spark):
    asked = {"role": "user", "content": "q", "at": 3}
    parts = {"role": "assistant", "content": [{"type": "text", "text": "a"}]}
    assert converted(
        spark,
        {"id": 1, "messages": [asked]},
        {"messages": []},
        {"messages": [asked, parts]},
        {"messages": [{"role": "user"}, {"content": "x"}]},
        {"messages": [{"role": "user"}]},
        {"instruction": "q", "output": "a", "meta": {"messages": [asked]}},
        {"id": 2, "messages": [], "turns": []},
    ) == [
        ("messages", [("user", "q")]),
        ("messages", []),
        ("messages", [("user", "q"), ("assistant", '[{"type":"text","text":"a"}]')]),
        ("messages", [("user", None), (None, "x")]),
        (None, None),
        ("instruction_only", [("user", "q"), ("assistant", "a")]),
        ("messages", []),
    ]


def test_of_several_layouts_the_one_with_more_fields_counts(spark):
    both = {"system": "s", "prompt": "p", "response": "r", "question": "x", "answer": "y"}
    found = converted(spark, both, {k: both[k] for k in ("prompt", "response", "question", "answer")})
    assert found == [
        ("system_prompt", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ("prompt", [("user", "p"), ("assistant", "r")]),
    ]


def test_tables_are_looked_up_by_fingerprint(spark):
    rows = T._parse_datatype_string(TURN_ROWS + ", more string")
    assert select_mapping(rows).name == "turn_rows"
    records = spark.createDataFrame([(7, "q", "a", "own")], "id int, prompt string, response string, turns string")
    found = table_turns(records)
    assert found.columns == ["id", "turns"] and [tuple(t) for t in found.first()["turns"]] == [("user", "q"), ("assistant", "a")]
    talk = spark.createDataFrame([(1, [("human", "q")])], "id int, conversations array<struct<from:string,value:string>>")
    assert [tuple(t) for t in table_turns(talk).first()["turns"]] == [("user", "q")]
    # Own row layouts are looked up in the same way.
    own = Mapping("log", "chat string, n int, who string, said string", role="who", text="said", key="chat", order="n")
    log = spark.createDataFrame([("c", 2, "user", "b"), ("c", 1, "user", "a")], own.layout)
    assert [tuple(t) for t in table_turns(log, (own,)).first()["turns"]] == [("user", "a"), ("user", "b")]


def test_own_mapping(spark):
    own = Mapping("nested", "chat struct<said:array<struct<who:string,what:string>>>", "chat.said", "who", "what")
    frame = spark.createDataFrame([('{"chat": {"said": [{"who": "user", "what": "x"}]}}',)], "r string")
    row = canonical_turns(frame, "r", (own,)).first()
    assert row["layout"] == "nested" and [tuple(t) for t in row["turns"]] == [("user", "x")]


def test_fingerprint_goes_by_paths():
    a = T._parse_datatype_string("a struct<x:string,y:array<struct<z:int>>>, b int")
    b = T._parse_datatype_string("b string, a struct<y:array<struct<z:string>>,x:int>")
    c = T._parse_datatype_string("b string, a struct<y:array<struct<w:string>>,x:int>")
    assert schema_fingerprint(a) == schema_fingerprint(b) != schema_fingerprint(c)


def test_other_tables_are_refused(spark):
    with pytest.raises(Exception, match="turn"):
        table_turns(spark.createDataFrame([(1, "a")], "conv_id long, body string"))
