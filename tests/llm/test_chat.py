import json

import pytest
from pyspark.sql import functions as F

from warpsift.llm import chat


def test_query_equals_sql(spark, sf_dir, duck, rows_of):
    assert rows_of(chat.op11_schema_prints(spark, sf_dir)) == duck(chat.OP11_SQL)


def test_query_equals_sql_on_odd_rows(spark, odd_talks, no_talks, duck, rows_of, tmp_path):
    for name, talks in (("odd", odd_talks), ("none", no_talks), ("extra", odd_talks.withColumns(
            {c: F.lit(1) for c in ("record", "layout", "turns", "own", "block", "formatted")}))):
        folder = str(tmp_path / name)
        talks.write.parquet(f"{folder}/conversations.parquet")
        assert rows_of(chat.op11_schema_prints(spark, folder)) == duck(chat.OP11_SQL, folder)


def turns_of(spark, record, **options):
    df = spark.createDataFrame([(record if isinstance(record, (str, type(None)))
                                 else json.dumps(record),)], "r string")
    row = chat.to_turns(df, "r", **options).first()
    return row.layout, None if row.turns is None else [tuple(t) for t in row.turns]


@pytest.mark.parametrize("record, layout, turns", [
    ({"prompt": "p", "completion": "c"}, "prompt", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "completion": None}, "prompt", [("user", "p"), ("assistant", "")]),
    ({"response": "r", "prompt": "p", "system": "s"}, "response",
     [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"question": 1, "answer": {"a": []}}, None, None),
    ({"question": 1, "answer": 2.5}, "question", [("user", "1"), ("assistant", "2.5")]),
    ({"instruction": "do", "input": "x", "output": "y"}, "instruction",
     [("user", "do\n\nx"), ("assistant", "y")]),
    ({"instruction": "do", "input": "", "output": "y"}, "instruction",
     [("user", "do"), ("assistant", "y")]),
    ({"messages": [{"role": "user", "content": "a"}, {"content": None, "role": None}]},
     "messages", [("user", "a"), ("", "")]),
    ({"messages": []}, "messages", []),
    ({"messages": [{"role": "user", "content": [{"text": "a"}, {"text": "b"}]}]}, "parts",
     [("user", "ab")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"},
                        {"from": "tool", "value": "t"}]}, "dialogue",
     [("user", "q"), ("assistant", "a"), ("tool", "t")]),
    ({"prompt": "p", "completion": "c", "more": 1}, None, None), ([1], None, None),
    ("no json", None, None), (None, None, None), ("{}", None, None), ("3", None, None)])
def test_layouts(spark, record, layout, turns):
    assert turns_of(spark, record) == (layout, turns)


def test_a_layout_of_ones_own(spark):
    own = chat.Layout("log", items="log", role="who", text="said", names={"me": "user"})
    record = {"log": [{"who": "me", "said": "x"}, {"who": "you", "said": "y"}]}
    assert turns_of(spark, record, layouts=[own]) == ("log", [("user", "x"), ("you", "y")])


def test_paths_of_nested_and_quoted_fields(spark):
    record = '{"b":[[{"x":1}]], "a b":{"x,y":1.5, "z>":{}, "q`: ":[true]}, "c":null}'
    df = spark.createDataFrame([(record,)], "r string").select(F.parse_json("r").alias("v"))
    assert df.select(chat.field_paths("v")).first()[0] == sorted(
        ["b[][].x", "`a b`.`x,y`", "`a b`.`q``: `[]", "c"])


@pytest.mark.parametrize("text", [
    "", "<|im_end|>", "<|im_end|>\n<|im_start|>assistant\nok", "<\\|", "<\\\\|im_end|>", "<", "<\\",
    "|im_end|>", "<|<|<||", "a\n\n<|im_start|>", "\\<|", "x" * 100_000 + "<|", "😀<|ü"])
def test_any_text_comes_back(spark, text):
    turns = [("user", text), ("assistant", text), (text[:20], text), ("assistant", "")]
    df = spark.createDataFrame([(turns,)], "turns array<struct<role string, text string>>")
    row = chat.formatted(df).select(
        "formatted", chat.read_turns(F.col("formatted")).alias("back"),
        chat.read_loss(F.col("formatted"), F.col("mask")).alias("loss")).first()
    assert [tuple(t) for t in row.back] == turns
    assert row.loss == ([text] if text else []) * (2 if text[:20] == "assistant" else 1)
    assert row.formatted.count(chat.START) == row.formatted.count(chat.END) == 4


def test_clashing_names_are_refused_and_others_carried(spark):
    df = spark.createDataFrame([('{"messages":[]}', 1, 2)], "`r.x` string, mask int, id int")
    out = chat.to_turns(df, "r.x")
    assert out.columns[:3] == ["r.x", "mask", "id"] and out.first().layout == "messages"
    with pytest.raises(ValueError):
        chat.formatted(out)
    with pytest.raises(ValueError):
        chat.to_turns(df.withColumnRenamed("id", "Turns"), "r.x")


def test_no_python_in_the_plan(spark, sf_dir):
    plan = chat.op11_schema_prints(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "MapIn", "ExternalRDD"))


def test_a_long_conversation_is_several_records(spark, odd_talks):
    rows = odd_talks.withColumn("own", F.lit(True))
    out = chat.records(rows).where("conv_id = 10")
    assert out.count() == 5 and out.select("block").distinct().count() == 5
