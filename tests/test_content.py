import json

import pytest
from pyspark.sql import functions as F

from chatprep.functions import content
from chatprep.operators import render
from chatprep.settings import TOKENS


def parse(spark, contents, role="user", **flags):
    rows = [(i, [(role, c)]) for i, c in enumerate(contents)]
    df = spark.createDataFrame(rows, "i int, messages array<struct<role:string,content:string>>")
    out = render.parse_content(df, **flags).orderBy("i").collect()
    return [
        None if r["parsed"][0]["parts"] is None else [(p["type"], p["text"]) for p in r["parsed"][0]["parts"]]
        for r in out
    ]


NUMBERS = [
    "3", "-0", "0.0", "1.50", "2.0", "1e3", "1e20", "1.5e-7", "0.00012", "0.0005", "12345678.5", "123456789.0",
    "1234567890123456.0", "1e16", "-7.25", "100000000", "123456789012345678901234567890", "true", "false",
]


def test_numbers_read_as_python_prints_them(spark):
    expected = [[("text", str(json.loads(n)))] for n in NUMBERS]
    assert parse(spark, NUMBERS) == expected
    assert parse(spark, NUMBERS, strip_parts=True) == expected


def test_numbers_inside_parts(spark):
    for strict in (True, False):
        got = parse(spark, [f'[{{"type":"text","text":{n}}}]' for n in NUMBERS], strip_parts=strict)
        assert got == [[("text", str(json.loads(n)))] for n in NUMBERS]


def test_raw_recipe_refuses_numbers(spark):
    assert parse(spark, ["3", "true", '"s"'], numeric_to_text=False) == [None, None, [("text", "s")]]


def test_kinds(spark):
    got = parse(spark, ['" a "', " [ ]", '{"a": 1}', "null", "no json", None, '"'])
    assert got == [[("text", " a ")], [], [], None, None, None, None]


SPACE = "\t\n  　\x1f"


def test_strip_touches_text_parts_only(spark):
    rows = [
        json.dumps([{"type": "text", "text": f"{SPACE}a{SPACE}b{SPACE}"}]),
        json.dumps(f"{SPACE}a{SPACE}"),
        json.dumps([{"type": "other", "text": " x "}, {"type": "image"}]),
    ]
    assert parse(spark, rows, strip_parts=True) == [
        [("text", f"{SPACE}a{SPACE}b{SPACE}".strip())],
        [("text", f"{SPACE}a{SPACE}")],
        [("other", None), ("image", None)],
    ]
    assert parse(spark, rows)[0] == [("text", f"{SPACE}a{SPACE}b{SPACE}")]


def test_strict_parts(spark):
    """Where stripping looks into a part, a part without type or text spoils the
    message; without it such parts are passed over."""
    rows = ['["x"]', '[{"text":"a"}]', '[{"type":"text"}]', '[{"type":"text","text":null}]', '[{"type":"text","text":[1]}]']
    assert parse(spark, rows, strip_parts=True) == [None] * 5
    lenient = parse(spark, rows)
    assert lenient[1:] == [[(None, None)], [("text", "")], [("text", "None")], None]
    assert lenient[0] == [(None, None)]


def shown(spark, messages, **flags):
    df = spark.createDataFrame([(messages,)], "messages array<struct<role:string,content:string>>")
    return render.render_chat(render.parse_content(df), TOKENS, **flags).first()["text"]


SYSTEM = ("system", '"S"')
ASK = ("user", '[{"type":"image"},{"type":"text","text":"Q"}]')
ANSWER = ("assistant", '[{"type":"image"},{"type":"text","text":"A"}]')
S, E = "<start_of_turn>", "<end_of_turn>"


def test_golden(spark):
    body = f"{S}### System:\nS\n\n{E}{S}### User:\n<img>Q\n\n{E}{S}### Assistant:\nA{E}"
    turns = [SYSTEM, ASK, ANSWER]
    assert shown(spark, turns) == body + "<eos>"
    assert shown(spark, turns, open_assistant=True) == body + "### Assistant:\n"
    assert shown(spark, turns, include_last=False) == body.replace("A" + E, E)
    assert shown(spark, turns, include_last=False, open_assistant=True) == body.replace("A" + E, E)


def test_only_a_last_assistant_loses_its_body(spark):
    got = shown(spark, [ANSWER, ASK], include_last=False)
    assert got == f"{S}### Assistant:\nA{E}{S}### User:\n<img>Q\n\n{E}"


def test_unknown_role_and_odd_parts(spark):
    odd = ("user", '[{"type":"video","text":"v"},{"type":"text","text":"t"}]')
    assert shown(spark, [("tool", '"x"'), odd, (None, '"y"')]) == f"{S}{E}{S}### User:\nt\n\n{E}{S}{E}<eos>"
    assert shown(spark, []) == "<eos>"
    assert shown(spark, [ASK, ("user", "null")]) is None


def test_caption_shortcut_equals_json_way(spark):
    df = spark.createDataFrame([(" a\n",), ('q"é',), ("",), (None,)], "caption string")
    short = df.select(content.caption_parsed(F.col("caption")).alias("p"))
    long = render.caption_to_chat(df).select(content.parse_messages("messages", strip_parts=True).alias("p"))
    assert short.collect() == long.collect()


@pytest.mark.parametrize("name", ["chat_sized", "chat_sized_raw"])
def test_sized_recipes_need_images(spark, name):
    from chatprep.plans import recipes

    df = spark.createDataFrame([(1, [ASK])], "row_id bigint, messages array<struct<role:string,content:string>>")
    with pytest.raises(ValueError, match="image_size"):
        recipes.apply(df, name, TOKENS)
    with pytest.raises(ValueError, match="unknown recipe"):
        recipes.apply(df, "", TOKENS)
    assert recipes.apply(df, "chat", TOKENS).first()["reason"] == "orphan_placeholder"
