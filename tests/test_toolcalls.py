import pytest
from pyspark.sql import functions as F

from rolloom.operators import toolcalls as tc
from tests.conftest import by

HERMES = [
    ("no call here", "no_call", 0),
    ('<tool_call>{"name":"finish"}', "unclosed_call", 0),
    ("</tool_call><tool_call>", "no_call", 0),
    ("<tool_call>{bad}</tool_call>", "bad_json", 1),
    ('<tool_call>{"name":"submit"} extra</tool_call>', "bad_json", 1),
    ("<tool_call>[1]</tool_call>", "not_object", 1),
    ('<tool_call>{"arguments":{}}</tool_call>', "missing_name", 1),
    ('<tool_call>{"name":7}</tool_call>', "name_not_string", 1),
    ('<tool_call>{"name":null}</tool_call>', "name_not_string", 1),
    ('<tool_call>{"name":"nope"}</tool_call>', "unknown_function", 1),
    ('<tool_call>{"name":"finish","arguments":"{x"}</tool_call>', "bad_argument_json", 1),
    ('<tool_call>{"name":"finish","arguments":"[1]"}</tool_call>', "arguments_not_object", 1),
    ('<tool_call>{"name":"finish","arguments":[1]}</tool_call>', "arguments_not_object", 1),
    ('<tool_call>{"name":"finish"}</tool_call><tool_call>{"name":"finish"}</tool_call>', "too_many_calls", 2),
    ('<tool_call>{"name":"finish"}</tool_call><tool_call>{x</tool_call>', "bad_json", 2),
    ('<tool_call>{"name":"finish","arguments":null}</tool_call>', None, 1),
]


def test_hermes_error_classes(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(HERMES)], "i int, text string")
    got = by(tc.parse_hermes_calls(df), "i")
    for i, (text, error, n) in enumerate(HERMES):
        assert (got[i]["error_class"], got[i]["n_calls"]) == (error, n), text


def test_hermes_actions(spark):
    texts = [
        'think <tool_call>\n{"name":"finish","arguments":{"answer":"x y","n":null,"l":[1,"a,b:c"],"t":true,"d":1.5}}\n</tool_call> tail',
        '<tool_call>{"name":"search","arguments":"{\\"command\\":\\"search\\",\\"topk\\":3}"}</tool_call>',
        '<tool_call>{"name":"execute_bash","arguments":{"command":" git log"}}</tool_call>',
        '<tool_call>{"name":"submit"}</tool_call>',
        '<tool_call>{"name":"finish","arguments":{"answer":"it\'s"}}</tool_call>',
        '<tool_call>{"name":"finish","arguments":{"answer":""}}</tool_call>',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = by(tc.flag_blocked(tc.render_action(tc.parse_hermes_calls(df))), "i")
    assert got[0]["action"] == "finish --answer 'x y' --n None --l '[1, \"a,b:c\"]' --t True --d 1.5"
    assert got[0]["content"] == "think "
    assert got[1]["action"] == "search search --topk 3"
    assert (got[2]["action"], got[2]["blocked"]) == (" git log", True)
    assert (got[3]["action"], got[3]["blocked"]) == ("echo '<<<Finished>>>'", False)
    assert got[4]["action"] == "finish --answer 'it'\"'\"'s'"
    assert got[5]["action"] == "finish --answer ''"


def _xml(name, *params):
    return f"<tool_call><function={name}>" + "".join(f"<parameter={k}>{v}</parameter>" for k, v in params) + "</function></tool_call>"


XML = [
    (_xml("finish", ("answer", "\nhi\n")), None, [("answer", "string", "hi")]),
    (_xml("finish", ("answer", "\n\nhi\n\n")), None, [("answer", "string", "\nhi\n")]),
    (_xml("finish", ("answer", "NULL")), None, [("answer", "null", "null")]),
    (_xml("search", ("topk", " 007 ")), None, [("topk", "int", "7")]),
    (_xml("search", ("topk", "-1_0")), None, [("topk", "int", "-10")]),
    (_xml("search", ("topk", "+5")), None, [("topk", "int", "5")]),
    (_xml("search", ("topk", "x")), "not_int", None),
    (_xml("search", ("topk", "5.0")), "not_int", None),
    (_xml("search", ("query_list", '["a", "b"]')), None, [("query_list", "array", '["a","b"]')]),
    (_xml("search", ("query_list", "['a', None]")), None, [("query_list", "array", '["a",null]')]),
    (_xml("search", ("query_list", "{{")), "bad_literal", None),
    (_xml("finish", ("foo", "1")), "unknown_parameter", None),
    (_xml("finish", ("foo", "null")), None, [("foo", "null", "null")]),
    (_xml("submit", ("q", "1")), None, [("q", "string", "1")]),
    (_xml("nope"), "unknown_function", None),
    (_xml("finish", ("answer", "a"), ("answer", "b")), None, [("answer", "string", "b")]),
    ("<tool_call><function=finish", "no_function_name", None),
    ("<tool_call><function=finish><parameter=answer</function></tool_call>", "no_parameter_name", None),
    ("<tool_call>zz</tool_call>", "no_call", None),
    ("plain", "no_call", None),
    ("<tool_call><function=finish><parameter=answer>open\n", None, [("answer", "string", "open")]),
    ("<tool_call><function=search><parameter=command>search<parameter=topk>2</function>", None, [("command", "string", "search"), ("topk", "int", "2")]),
    (_xml("submit") + _xml("submit"), "too_many_calls", None),
]


def test_xml_dialect(spark):
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(XML)], "i int, text string")
    got = by(tc.parse_xml_calls(df), "i")
    for i, (text, error, args) in enumerate(XML):
        assert got[i]["error_class"] == error, text
        mine = None if got[i]["arguments"] is None else [(a["key"], a["kind"], a["text"]) for a in got[i]["arguments"]]
        assert mine == args, text


def test_xml_number_and_bool_types(spark):
    tools = {"t": {"x": "number", "b": "boolean", "o": "object", "z": "mystery"}}
    cases = [
        (("x", "1.0"), ("int", "1"), None),
        (("x", "1.5"), ("float", "1.5"), None),
        (("x", "1e3"), ("int", "1000"), None),
        (("x", "inf"), None, "not_float"),
        (("x", "1d"), None, "not_float"),
        (("b", "True"), ("bool", "true"), None),
        (("b", "1"), None, "not_bool"),
        (("o", '{"a": 1}'), ("object", '{"a":1}'), None),
        (("o", "{'a': 1}"), ("object", '{"a":1}'), None),
        (("z", "3"), ("int", "3"), None),
        (("z", "abc"), None, "bad_literal"),
    ]
    df = spark.createDataFrame([(i, _xml("t", c[0])) for i, c in enumerate(cases)], "i int, text string")
    got = by(tc.parse_xml_calls(df, tools), "i")
    for i, (param, value, error) in enumerate(cases):
        assert got[i]["error_class"] == error, param
        if value:
            assert (got[i]["arguments"][0]["kind"], got[i]["arguments"][0]["text"]) == value, param


def test_structured_calls_and_list_arguments(spark):
    schema = "i int, text string, tool_calls array<struct<id:string,name:string,arguments:string>>"
    rows = [(0, "c", [("1", "finish", '{"answer":1}')]), (1, "c", [("1", "zz", "{}")]), (2, "c", [("1", "finish", "{")]), (3, "c", []), (4, "c", [("1", "finish", "{}")] * 2), (5, "c", None)]
    got = by(tc.parse_structured_calls(spark.createDataFrame(rows, schema)), "i")
    assert [got[i]["error_class"] for i in range(6)] == [None, "unknown_function", "structured_bad_json", "no_call", "too_many_calls", "no_call"]
    lists = [('["a",1,true,null]', ["a", "1", "True", "None"]), ("['x', 2]", ["x", "2"]), ("abc", ["abc"]), ("", []), (None, []), ("{'a':1}", ["{'a':1}"])]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(lists)], "i int, v string")
    got = by(tc.parse_list_arg(df, "v", "o"), "i")
    assert [got[i]["o"] for i in range(len(lists))] == [w for _, w in lists]


def test_parser_registry(spark):
    df = spark.createDataFrame([("hello",)], "text string")
    assert tc.parse_calls(df, "hermes").first()["error_class"] == "no_call"
    with pytest.raises(ValueError):
        tc.parse_calls(df, "other")
    tc.register_parser("other", tc.parse_hermes_calls)
    assert tc.parse_calls(df, "other").count() == 1
    tc._PARSERS.pop("other")


def test_of_duplicate_json_keys_the_last_counts(spark):
    from rolloom.functions.jsonv import member_text, strict_json

    df = spark.createDataFrame([('{"answer":"x","answer":"y"}',)], "t string")
    assert df.select(F.try_variant_get(strict_json(F.col("t")), "$.answer", "string").alias("a")).first().a == "y"
    assert df.select(strict_json(F.lit("{} x")).isNull().alias("a"), member_text(F.col("t"), "answer").isNotNull().alias("b")).first().a


def test_feedback_names_values_and_what_is_allowed(spark):
    from rolloom.operators import toolcalls as tc

    def told(texts, parse, hint=None):
        df = parse(spark.createDataFrame(list(enumerate(texts)), "i int, text string"))
        return [r.m for r in df.select("i", tc.error_message(hint=hint).alias("m")).orderBy("i").collect()]

    wrap = lambda name, key, value: f"<tool_call>\n<function={name}>\n<parameter={key}>\n{value}\n</parameter>\n</function>\n</tool_call>"
    got = told([wrap("search", "topk", "abc"), wrap("search", "nope", "1"), wrap("search", "query_list", "[1,"), "no call"], tc.parse_xml_calls)
    assert got[0] == "Invalid action: value 'abc' of parameter 'topk' is not an integer in tool call 'search'."
    assert got[1] == f"Invalid action: parameter 'nope' is not defined in the parameters for function 'search'.\nAllowed parameters for function 'search': {list(tc.TOOLS['search'])}."
    assert got[2] == "Invalid action: value '[1,' of parameter 'query_list' is not valid in tool call 'search'." and got[3] == "No function call found in the response."
    body = lambda x: f"<tool_call>{x}</tool_call>"
    got = told(["none", body("[1]"), body("{}"), body('{"name": 3}'), body('{"name":"finish","arguments":[1]}')], tc.parse_hermes_calls, tc.HERMES_HINT)
    assert got == [
        f"No function call found in the response. {tc.HERMES_HINT}", f"Invalid tool_call: expected a JSON object, got list. {tc.HERMES_HINT}", f"Invalid tool_call: missing 'name' field. {tc.HERMES_HINT}",
        "Invalid tool_call: 'name' must be a string, got int.", "Invalid arguments for 'finish': expected a JSON object, got list.",
    ]
