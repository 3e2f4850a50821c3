"""Tool calls with arguments and schemas that are odd: no job ends over them."""

import json

from quarry.llm import chat


def test_odd_arguments(spark):
    odd = {"a": '{"x":"\\ud800"}', "b": '{"x":' + "9" * 400 + "}", "c": '{"x":NaN}', "d": "[" * 200_000 + "]" * 200_000, "e": '{"x":1}', "f": '{"\\ud800":1}', "g": None, "h": '{"x":1}', "i": '{"x":1e400}'}
    names = {"a": "f", "e": "broken", "h": "list"}
    calls = spark.createDataFrame([("c", k, None, names.get(k, "f"), v) for k, v in odd.items()], "conv_id string, call_id string, parent_id string, name string, arguments string")
    results = spark.createDataFrame([("c", k, "r") for k in odd], "conv_id string, call_id string, content string")
    schema = {"type": "object", "properties": {"x": {"type": "integer"}}, "additionalProperties": False}
    schemas = spark.createDataFrame([("f", json.dumps(schema)), ("broken", "{"), ("list", "[1]")], "name string, schema string")
    got = {r.call_id: r for r in chat.link_calls(calls, results, schemas).collect()}
    assert got["a"].errors == ["$.x: not integer"] and "\\ud800" in got["a"].json
    assert got["b"].errors == [] and "9" * 400 in got["b"].json
    assert all("arguments are no JSON" in got[k].errors for k in "cdgi")
    assert got["e"].errors == ["schema is no JSON object"] == got["h"].errors
    assert len(got["f"].errors) == 1 and "unknown" in got["f"].errors[0]
