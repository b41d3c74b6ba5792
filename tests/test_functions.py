import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorewell.functions import json_repair, prompts, text, vectors
from lorewell.sources.readers import split_paragraphs


def _apply(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, t string").select("i", column.alias("x")).collect()
    return [r["x"] for r in sorted(rows)]


def _paragraphs(whole):
    out, now = [], ""
    for line in whole.split("\n"):
        if line.strip() == "":
            out, now = out + [now] * bool(now), ""
        else:
            now += line + "\n"
    return out + [now] * bool(now)


def test_blank_and_words_are_those_of_python(spark):
    rng = random.Random(3)
    values = ["".join(rng.choice(" \t\r\n\x0b\x1c\x1f\x85  　ab​") for _ in range(rng.randint(0, 9))) for _ in range(400)]
    assert _apply(spark, values, text.is_blank("t")) == [not v.strip() for v in values]
    assert _apply(spark, values, text.word_count("t")) == [len(v.split()) for v in values]
    assert _apply(spark, values, split_paragraphs(F.col("t"))) == [_paragraphs(v) for v in values]


def test_labels_keys_and_triple_texts(spark):
    assert _apply(spark, ["short", "1234567", "12345678", "a\nb", "一二三四五六七八九"], text.label("t")) == ["short", "1234567", "12345678...", "a b", "一二三四五六七八..."]
    assert _apply(spark, ["x"], text.key("entity", "t"))[0].startswith("entity-2d711642b726b044")
    assert _apply(spark, ["('a', 'b', 'c d')"], text.parse_triple_text("t")) == [["a", "b", "c d"]]
    assert _apply(spark, ["a"], text.triple_text("t", F.lit("b"), F.lit("c"))) == ["('a', 'b', 'c')"]


def test_reasoning_and_list_slices(spark):
    values = ["plain", "<think>why</think>so", "<think>open", "a<think>b</think>c</think>d", "x<think>1</think>2"]
    found = _apply(spark, values, text.split_reasoning("t"))
    assert [tuple(r) for r in found] == [(None, "plain"), ("why", "so"), (None, "open"), (None, "b"), ("1", "2")]
    assert _apply(spark, ["x [1] y", "[1, [2", "a] b", "none", "]["], text.json_list_slice("t")) == ["[1]", "[1, [2", "a]", "none", "["]


def test_typed_attributes(spark):
    df = spark.createDataFrame([("3", "int"), ("2.5", "float"), ("x", "str"), ("y", "int")], "v string, k string")
    assert [tuple(r["t"]) for r in df.select(text.typed("v", "k").alias("t")).collect()] == [(3, None, None), (None, 2.5, None), (None, None, "x"), (None, None, None)]


def test_repair(spark):
    cases = {'["a", "b"]': ["a", "b"], '[["a","b","c"],["d","e"': [["a", "b", "c"], ["d"]], '{"a": [1, {"b": 2, "c': {"a": [1, {"b": 2}]}, '["x,]", "y': ["x,]"], '["q\\"", 1': ['q"']}
    for broken, whole in cases.items():
        assert json.loads(json_repair.repair(broken)) == whole
    assert [json.loads(x) for x in _apply(spark, list(cases), json_repair.repaired("t"))] == list(cases.values())
    assert _apply(spark, [None], json_repair.repaired("t")) == [None]


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=12))
def test_repair_keeps_what_is_valid(value):
    whole = json.dumps(value)
    assert json_repair.repair(whole) == whole


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    rows = df.select(vectors.dot("a", "b").alias("d"), vectors.normalized("a").alias("n")).collect()
    assert [(r["d"], r["n"]) for r in rows] == [(11.0, [0.6, 0.8]), (0.0, [0.0, 0.0])]


def test_prompts(spark):
    df = spark.createDataFrame([("q", [(0.5, "p1"), (0.25, "p2")])], "q string, k array<struct<score: double, text: string>>")
    system, user = df.select(prompts.answer_messages("q", "k").alias("m")).first()["m"]
    assert system["role"] == "system" and system["content"] == prompts.ANSWER_PROMPT
    assert user["content"] == "问题：\nq\n\n可能有帮助的信息：\n1. 相关性：0.5\np1\n2. 相关性：0.25\np2"
    assert df.select(prompts.triple_messages("q", F.lit("[]")).alias("m")).first()["m"][1]["content"] == "段落：\n```\nq```\n\n实体列表：\n```\n[]```"
