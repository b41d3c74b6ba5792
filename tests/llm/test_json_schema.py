"""Arguments of tool calls against JSON schemas."""

import json

from lorewell.llm import json_schema, tool_chat

O = {"properties": {"o": {"type": "object", "properties": {"n": {"type": "integer", "minimum": 1}}, "required": ["n"], "additionalProperties": False}}}
TREE = {"$ref": "#/$defs/t", "$defs": {"t": {"type": "object", "properties": {"v": {"type": "number"}, "kids": {"type": "array", "items": {"$ref": "#/$defs/t"}}}, "required": ["v"]}}}
P = lambda s: {"properties": {"x": s}}
CASES = [
    ({}, {"a": 1}, True), (True, 1, True), (False, 1, False), (O, {"o": {"n": 1}}, True), (O, {"o": {"n": 0}}, False), (O, {"o": {"n": 1.5}}, False), (O, {"o": {}}, False), (O, {"o": {"n": 2, "z": 1}}, False), (O, {"o": 5}, False),
    (P({"type": ["string", "null"]}), {"x": None}, True), (P({"type": ["string", "null"]}), {"x": 1}, False), (P({"type": "integer"}), {"x": 2.0}, True), (P({"type": "integer"}), {"x": 1e2}, True),
    (P({"items": {"type": "string"}}), {"x": ["a", 1]}, False), (P({"items": {"type": "string"}}), {"x": ["a", "b"]}, True), (P({"prefixItems": [{"type": "string"}], "items": False}), {"x": ["a"]}, True), (P({"prefixItems": [{"type": "string"}], "items": False}), {"x": ["a", 1]}, False),
    (P({"minItems": 2, "maxItems": 3}), {"x": [1]}, False), (P({"minItems": 2, "maxItems": 3}), {"x": [1, 2, 3]}, True), (P({"uniqueItems": True}), {"x": [1, None, None]}, False), (P({"uniqueItems": True}), {"x": [1, "1", None]}, True), (P({"contains": {"type": "string"}}), {"x": [1, "a"]}, True), (P({"contains": {"type": "string"}}), {"x": []}, False),
    (P({"maximum": 3}), {"x": 3}, True), (P({"maximum": 3}), {"x": 3.5}, False), (P({"exclusiveMaximum": 3}), {"x": 3}, False), (P({"exclusiveMinimum": 0}), {"x": 0.1}, True), (P({"maximum": 9007199254740992}), {"x": 9007199254740993}, False), (P({"multipleOf": 0.1}), {"x": 0.3}, True), (P({"multipleOf": 2}), {"x": 3}, False), (P({"maximum": 3}), {"x": "9"}, True),
    (P({"minLength": 2, "maxLength": 3}), {"x": "é"}, False), (P({"minLength": 2, "maxLength": 3}), {"x": "é😀"}, True), (P({"minLength": 2, "maxLength": 3}), {"x": "abcd"}, False),
    (P({"pattern": "^[A-Z]{2,3}-\\d+$"}), {"x": "AB-12"}, True), (P({"pattern": "^[A-Z]{2,3}-\\d+$"}), {"x": "AB-12\n"}, False), (P({"pattern": "^(?:a|b(c|d)*)+$"}), {"x": "abcd"}, True), (P({"pattern": "^(?:a|b(c|d)*)+$"}), {"x": "abe"}, False),
    (P({"pattern": "(unclosed"}), {"x": "a"}, None), (P({"pattern": "[z-a]"}), {"x": "a"}, None), (P({"pattern": "a{3,1}"}), {"x": "a"}, None), (P({"pattern": "*a"}), {"x": "a"}, None), (P({"pattern": "a\\"}), {"x": "a"}, None),
    (P({"const": {"a": [1, None]}}), {"x": {"a": [1, None]}}, True), (P({"const": 1}), {"x": 2}, False), (P({"const": None}), {"x": None}, True), (P({"const": None}), {"x": 1}, False), (P({"enum": ["a", None]}), {"x": None}, True), (P({"enum": ["a", 2]}), {"x": "2"}, False), (P({"enum": [1]}), {"x": 1.0}, True),
    (P({"anyOf": [{"type": "string"}, {"minimum": 5}]}), {"x": 4}, False), (P({"anyOf": [{"type": "string"}, {"minimum": 5}]}), {"x": 6}, True), (P({"oneOf": [{"type": "number"}, {"minimum": 5}]}), {"x": 6}, False), (P({"oneOf": [{"type": "number"}, {"minimum": 5}]}), {"x": 4}, True),
    (P({"allOf": [{"type": "number"}, {"minimum": 5}]}), {"x": 4}, False), (P({"not": {"type": "number"}}), {"x": 4}, False), (P({"not": {"type": "number"}}), {"x": "4"}, True),
    ({"if": {"required": ["a"]}, "then": {"required": ["b"]}, "else": {"required": ["c"]}}, {"a": 1}, False), ({"if": {"required": ["a"]}, "then": {"required": ["b"]}, "else": {"required": ["c"]}}, {"a": 1, "b": 1}, True), ({"if": {"required": ["a"]}, "then": {"required": ["b"]}, "else": {"required": ["c"]}}, {"d": 1}, False),
    ({"additionalProperties": {"type": "string"}, "properties": {"k": {}}}, {"k": 1, "z": "a"}, True), ({"additionalProperties": {"type": "string"}}, {"z": 1}, False), ({"patternProperties": {"^n_": {"type": "number"}}, "additionalProperties": False}, {"n_a": 1}, True), ({"patternProperties": {"^n_": {"type": "number"}}, "additionalProperties": False}, {"n_a": "1"}, False), ({"patternProperties": {"^n_": {"type": "number"}}, "additionalProperties": False}, {"m": 1}, False),
    ({"propertyNames": {"maxLength": 2}}, {"ab": 1}, True), ({"propertyNames": {"maxLength": 2}}, {"abc\"": 1}, False), ({"minProperties": 1}, {}, False), ({"maxProperties": 1}, {"a": 1, "b": 2}, False), ({"dependentRequired": {"a": ["b"]}}, {"a": 1}, False), ({"dependentRequired": {"a": ["b"]}}, {"c": 1}, True), ({"dependentSchemas": {"a": {"required": ["b"]}}}, {"a": 1}, False),
    (TREE, {"v": 1, "kids": [{"v": 2, "kids": [{"v": 3}]}]}, True), (TREE, {"v": 1, "kids": [{"v": 2, "kids": [{"w": 3}]}]}, False), ({"$ref": "#"}, {}, None), ({"$ref": "http://x/y"}, {}, None), ({"unevaluatedProperties": False}, {}, None), ({"unevaluatedProperties": False, "required": ["a"]}, {}, False), ({"$ref": "#/$defs/gone"}, {}, None),
]


def test_keywords(spark):
    rows = [(i, json.dumps(s), json.dumps(v)) for i, (s, v, _) in enumerate(CASES)]
    pairs = spark.createDataFrame(rows, "k long, schema string, value string").selectExpr("k", "to_json(parse_json(schema)) AS schema", "to_json(parse_json(value)) AS value")
    got = {r["k"]: r["valid"] for r in json_schema.validate(pairs, ["k"]).collect()}
    assert [(c, got[i]) for i, c in enumerate(CASES) if got[i] is not c[2]] == [] and len(got) == len(CASES)


def test_invalid_below_the_first_level_counts(spark):
    tools = {"tools": [{"name": "f", "parameters": O}, {"name": "g", "parameters": {"unevaluatedProperties": False}}]}
    calls = {"tool_calls": [{"id": str(i), "name": n, "arguments": a} for i, (n, a) in enumerate([("f", {"o": {"n": 0}}), ("f", {"o": {"n": 3}}), ("f", {"o": {}}), ("g", {}), ("h", {}), ("f", 5), ("g", None)])]}
    rows = [(c, i, "x", json.dumps(x)) for c in (1, None) for i, x in enumerate((tools, calls))]
    got = tool_chat.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("turn = 1").collect()
    assert [r["n_invalid"] for r in got] == [4, 4]
    assert [[c.get("valid") for c in json.loads(r["line"])["tool_calls"]] for r in got] == [[False, True, False, None, None, False, False]] * 2
