"""Tool-call audit: one row per assistant turn with the parsed call or an error class."""

from __future__ import annotations

import ast
import json
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolloom.functions import jsonv
from rolloom.functions.text import py_words, shell_quote

# Tool names with their parameters and JSON types.
TOOLS: dict[str, dict[str, str]] = {
    "execute_bash": {"command": "string"},
    "finish": {"answer": "string"},
    "search": {"command": "string", "query_list": "array", "url_list": "array", "topk": "integer"},
    "search_arxiv": {"query": "string", "max_results": "integer", "days": "integer"},
    "str_replace_editor": {
        "command": "string",
        "path": "string",
        "file_text": "string",
        "insert_line": "integer",
        "new_str": "string",
        "old_str": "string",
        "view_range": "array",
    },
    "submit": {},
}

# Patterns, words and limits of the call formats.
CALL_OPEN = "<tool_call>"
CALL_CLOSE = "</tool_call>"
XML_CALL = r"(?sd)<tool_call>(.*?)(?:</tool_call>|$)"
XML_FUNCTION = r"(?s)<function=(.*?)(?:</function>|\z)"
XML_PARAMETER = r"(?sd)<parameter=(.*?)(?:</parameter>|(?=<parameter=)|(?=</function>)|$)"
HERMES_CALL = r"(?sU)<tool_call>\s*(.*?)\s*</tool_call>"
STRING_TYPES = ["string", "str", "text", "varchar", "char", "enum"]
BOOL_TYPES = ["boolean", "bool", "binary"]
BLOCKED_COMMANDS = ["git", "ipython", "jupyter", "nohup"]
SUBMIT_ACTION = "echo '<<<Finished>>>'"
MAX_PARALLEL_CALLS = 1

# Error classes in the order the audit reports them.
ERROR_CLASSES = [
    "no_call",
    "unclosed_call",
    "no_function_name",
    "unknown_function",
    "no_parameter_name",
    "unknown_parameter",
    "not_int",
    "not_float",
    "not_bool",
    "bad_literal",
    "bad_json",
    "not_object",
    "missing_name",
    "name_not_string",
    "bad_argument_json",
    "arguments_not_object",
    "structured_bad_json",
    "too_many_calls",
]

# numbers with their underscores anywhere, and an underscore that is not between digits; no
# group is repeated, as the JVM matches repeated groups by recursion
_INT = r"(?U)^\s*[+-]?\d[\d_]*+\s*$"
_FLOAT = r"(?U)^\s*[+-]?(?:\d[\d_]*+(?:\.[\d_]*+)?|\.\d[\d_]*+)(?:[eE][+-]?\d[\d_]*+)?\s*$"
_LOOSE_UNDERSCORE = r"(?U)(?<!\d)_|_(?!\d)"


def _check(tools: Mapping[str, Mapping[str, str]]) -> list[str]:
    """Tool names in order; the schemas are the caller's configuration and literals of the plan."""
    return sorted(tools)


def _names(tools) -> Column:
    return F.array(*[F.lit(n) for n in _check(tools)]).cast("array<string>")


def _literal_to_json(text: str | None) -> str | None:
    """JSON text of a Python literal, or null when it is not one."""
    if text is None:
        return None
    try:
        return json.dumps(ast.literal_eval(text), ensure_ascii=False, default=str)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def literals_to_json(texts: pd.Series) -> pd.Series:
    """Decode arrays of Python literals; rows without pending literals carry an empty array."""
    return texts.map(lambda a: None if a is None else [_literal_to_json(t) for t in a])


# a filter on an outcome must not be pushed below the decoder, where it cannot be evaluated
literals_to_json = literals_to_json.asNondeterministic()


# --- shared shape -----------------------------------------------------------


def _first_error(calls: Column) -> Column:
    """First failing call, in call order."""
    return F.try_element_at(F.filter(calls, lambda c: c["error"].isNotNull()), F.lit(1))


def _outcome(df: DataFrame, no_call: Column, unclosed: Column) -> DataFrame:
    """Fold ``_calls`` into one call or one error per turn."""
    n = F.size("_calls")
    df = df.withColumns(
        {
            "_bad": _first_error(F.col("_calls")),
            "_call": F.try_element_at(F.filter("_calls", lambda c: c["error"].isNull()), F.lit(1)),
            "n_calls": F.when(no_call | unclosed, 0).otherwise(n),
        }
    )
    error = (
        F.when(no_call, "no_call")
        .when(unclosed, "unclosed_call")
        .when(n == 0, "no_call")
        .when(F.col("_bad").isNotNull(), F.col("_bad.error"))
        .when(n > MAX_PARALLEL_CALLS, "too_many_calls")
    )
    good = F.col("error_class").isNull()
    return (
        df.withColumn("error_class", error)
        .withColumns(
            {
                "tool": F.when(good, F.col("_call.name")).otherwise(F.col("_bad.name")),
                "arguments": F.when(good, F.col("_call.args")),
                "detail": F.when(good, None).otherwise(F.col("_bad.detail")),
                "value": F.when(good, None).otherwise(F.col("_bad.value")),
            }
        )
        .drop("_calls", "_bad", "_call")
    )


def _content(text: Column) -> Column:
    return F.when(F.col("error_class").isNull(), F.substring_index(text, CALL_OPEN, 1))


# --- Hermes dialect ---------------------------------------------------------


def _type_name(kind: Column) -> Column:
    """Name that Python gives the type of a JSON value."""
    names = {"array": "list", "object": "dict", "string": "str", "null": "NoneType"}
    out = kind
    for k, n in names.items():
        out = F.when(kind == k, n).otherwise(out)
    return out


def _hermes_call(raw: Column, names: Column) -> Column:
    def facts(v: Column) -> Column:
        return F.struct(
            jsonv.json_kind(v).alias("kind"),
            jsonv.json_kind(jsonv.member(v, "name")).alias("name_kind"),
            jsonv.member_text(raw, "name").alias("name"),
            jsonv.json_kind(jsonv.member(v, "arguments")).alias("given"),
        )

    def with_args(s: Column) -> Column:
        empty = s["given"].isNull() | (s["given"] == "null")
        args = F.when(empty, "{}").otherwise(jsonv.member_text(raw, "arguments"))
        kind = F.when(empty | (s["given"] == "object"), "object").otherwise(jsonv.json_kind(jsonv.strict_json(args)))
        return jsonv.let(F.struct(args.alias("text"), kind.alias("kind")), lambda a: graded(s, a))

    def graded(s: Column, a: Column) -> Column:
        error = (
            F.when(s["kind"].isNull(), "bad_json")
            .when(s["kind"] != "object", "not_object")
            .when(s["name_kind"].isNull(), "missing_name")
            .when(s["name_kind"] != "string", "name_not_string")
            .when(~F.array_contains(names, s["name"]), "unknown_function")
            .when((s["given"] == "string") & a["kind"].isNull(), "bad_argument_json")
            .when(a["kind"] != "object", "arguments_not_object")
        )
        wrong = lambda e: F.when(e == "not_object", s["kind"]).when(e == "name_not_string", s["name_kind"]).when(e == "arguments_not_object", a["kind"])
        return jsonv.let(
            error,
            lambda e: F.struct(
                e.alias("error"),
                F.when((s["kind"] == "object") & (s["name_kind"] == "string"), s["name"]).alias("name"),
                a["text"].alias("args"),
                F.lit(None).cast("string").alias("detail"),
                jsonv.let(wrong(e), _type_name).alias("value"),
            ),
        )

    return jsonv.let(jsonv.strict_json(raw), lambda v: jsonv.let(facts(v), with_args))


def parse_hermes_calls(df: DataFrame, tools: Mapping[str, Mapping[str, str]] = TOOLS, text: str = "text") -> DataFrame:
    """Parse ``<tool_call>{json}</tool_call>`` turns."""
    t = F.col(text)
    raws = F.regexp_extract_all(t, F.lit(HERMES_CALL), F.lit(1))
    calls = F.transform(raws, lambda r: _hermes_call(r, _names(tools)))
    has_open = t.contains(CALL_OPEN)
    parsed = _outcome(df.withColumn("_calls", calls), ~has_open, has_open & ~t.contains(CALL_CLOSE))
    parsed = parsed.withColumn("arguments", jsonv.entries(F.col("arguments")))
    return parsed.withColumn("content", _content(t))


# --- XML dialect ------------------------------------------------------------


def _cut_newlines(v: Column) -> Column:
    return F.regexp_replace(v, r"\A\n|\n\z", "")


def _xml_result(error=None, key=None, kind=None, text=None, literal=None) -> Column:
    fields = {"error": error, "key": key, "kind": kind, "text": text, "literal": literal}
    return F.struct(*[(F.lit(v) if v is None or isinstance(v, str) else v).cast("string").alias(n) for n, v in fields.items()])


def _is_number(value: Column, pattern: str) -> Column:
    return value.rlike(pattern) & ~(value.contains("_") & value.rlike(_LOOSE_UNDERSCORE))


def _xml_number(value: Column, name: Column) -> Column:
    def graded(x: Column) -> Column:
        whole = F.when(F.abs(x) < 1e38, x.cast("decimal(38,0)"))
        return jsonv.let(
            F.struct(x.alias("x"), whole.alias("w")),
            lambda s: F.when(s["x"].isNull() | (F.abs(s["x"]) == float("inf")), _xml_result("not_float", name, None, value))
            .when(s["x"] == s["w"].cast("double"), _xml_result(None, name, "int", s["w"]))
            .otherwise(_xml_result(None, name, "float", s["x"])),
        )

    return jsonv.let(F.when(_is_number(value, _FLOAT), F.regexp_replace(value, r"(?U)[\s_]", "").try_cast("double")), graded)


def _xml_integer(value: Column, name: Column) -> Column:
    digits = F.regexp_replace(F.regexp_replace(value, r"(?U)[\s_]|^\s*\+", ""), r"^\+?(-?)0+(?=\d)", "$1")
    text = F.when(digits == "-0", "0").otherwise(F.ltrim(digits, F.lit("+")))
    return F.when(_is_number(value, _INT), _xml_result(None, name, "int", text)).otherwise(_xml_result("not_int", name, None, value))


def _xml_nested(value: Column, name: Column) -> Column:
    shown = F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")
    return jsonv.let(
        jsonv.json_kind(jsonv.strict_json(value)),
        lambda k: F.when(k.isNotNull(), _xml_result(None, name, k, shown)).otherwise(_xml_result(None, name, None, None, value)),
    )


def _xml_typed(value: Column, kind: Column, name: Column) -> Column:
    """Typed value of one parameter, or the literal still to be decoded, or an error."""
    low = F.lower(value)
    is_bool = kind.isin(BOOL_TYPES)
    return (
        F.when(low == "null", _xml_result(None, name, "null", "null"))
        .when(kind.isin(STRING_TYPES), _xml_result(None, name, "string", value))
        .when(kind.rlike("^(int|uint|long|short|unsigned)"), _xml_integer(value, name))
        .when(kind.rlike("^(num|float)"), _xml_number(value, name))
        .when(is_bool & low.isin("true", "false"), _xml_result(None, name, "bool", low))
        .when(is_bool, _xml_result("not_bool", name, None, low))
        .when(kind.isin("object", "array", "arr") | kind.rlike("^(dict|list)"), _xml_nested(value, name))
        .otherwise(_xml_result(None, name, None, None, value))
    )


def _xml_parameter(match: Column, spec: Column) -> Column:
    facts = F.struct(
        F.split_part(match, F.lit(">"), F.lit(1)).alias("name"),
        _cut_newlines(F.substring(match, F.locate(">", match) + 1, F.length(match))).alias("value"),
    )

    def graded(p: Column) -> Column:
        unknown = (F.size(spec) > 0) & ~F.map_contains_key(spec, p["name"]) & (F.lower(p["value"]) != "null")
        kind = F.lower(F.trim(F.coalesce(spec[p["name"]], F.lit("string"))))
        return (
            F.when(~match.contains(">"), _xml_result("no_parameter_name"))
            .when(unknown, _xml_result("unknown_parameter", p["name"]))
            .otherwise(jsonv.let(kind, lambda k: _xml_typed(p["value"], k, p["name"])))
        )

    return jsonv.let(facts, graded)


def _xml_function(body: Column, specs: Column, names: Column) -> Column:
    rest = F.substring(body, F.locate(">", body) + 1, F.length(body))

    def graded(name: Column) -> Column:
        error = F.when(~body.contains(">"), "no_function_name").when(~F.array_contains(names, name), "unknown_function")
        matches = F.regexp_extract_all(rest, F.lit(XML_PARAMETER), F.lit(1))
        params = jsonv.let(specs[name], lambda spec: F.transform(matches, lambda m: _xml_parameter(m, spec)))
        return jsonv.let(
            error,
            lambda e: F.struct(
                e.alias("error"), F.when(body.contains(">"), name).alias("name"), F.when(e.isNull(), params).alias("params")
            ),
        )

    return jsonv.let(F.split_part(body, F.lit(">"), F.lit(1)), graded)


def _spec_literal(tools: Mapping[str, Mapping[str, str]]) -> Column:
    def params(p: Mapping[str, str]) -> Column:
        flat = [F.lit(x) for kv in p.items() for x in kv]
        return F.create_map(*flat).cast("map<string,string>")

    return F.create_map(*[x for n in _check(tools) for x in (F.lit(n), params(tools[n]))])


def parse_xml_calls(
    df: DataFrame,
    tools: Mapping[str, Mapping[str, str]] = TOOLS,
    text: str = "text",
    decode_literals: Callable[[Column], Column] | None = literals_to_json,
) -> DataFrame:
    """Parse ``<function=NAME><parameter=KEY>VALUE`` turns and type their arguments.

    Only values that are neither plain types nor JSON reach ``decode_literals``
    (an Arrow-batched Python literal decoder); every other row sends it an empty array.
    """
    t = F.col(text)
    specs, names = _spec_literal(tools), _names(tools)
    blocks = F.regexp_extract_all(t, F.lit(XML_CALL), F.lit(1))
    bodies = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(XML_FUNCTION), F.lit(1))))
    df = df.withColumn("_fns", F.transform(bodies, lambda b: _xml_function(b, specs, names)))
    params = F.flatten(F.transform("_fns", lambda f: F.coalesce(f["params"], F.array())))
    pending = F.transform(F.filter(params, lambda p: p["literal"].isNotNull()), lambda p: p["literal"])
    df = df.withColumn("_pending", pending)
    df = df.withColumn("_decoded", decode_literals(F.col("_pending")) if decode_literals else F.transform("_pending", lambda _: F.lit(None).cast("string")))

    def settle(p: Column) -> Column:
        at = F.array_position("_pending", p["literal"])
        found = F.when(p["literal"].isNotNull(), F.get("_decoded", (at - 1).cast("int")))

        def merged(f: Column) -> Column:
            text_ = F.get_json_object(F.concat(F.lit('{"v":'), f, F.lit("}")), "$.v")
            return F.struct(
                F.when(p["literal"].isNotNull() & f.isNull(), "bad_literal").otherwise(p["error"]).alias("error"),
                p["key"].alias("key"),
                F.coalesce(jsonv.json_kind(jsonv.strict_json(f)), p["kind"]).alias("kind"),
                F.coalesce(text_, F.when(p["literal"].isNotNull() & f.isNull(), p["literal"]), p["text"], F.lit("null")).alias("text"),
            )

        return jsonv.let(found, merged)

    def fold(f: Column) -> Column:
        def keep(settled: Column) -> Column:
            first_bad = F.try_element_at(F.filter(settled, lambda p: p["error"].isNotNull()), F.lit(1))
            return jsonv.let(
                first_bad,
                lambda b: F.struct(
                    F.coalesce(f["error"], b["error"]).alias("error"),
                    f["name"].alias("name"),
                    F.when(f["error"].isNull() & b["error"].isNull(), last_values(settled)).alias("args"),
                    F.when(f["error"].isNull(), b["key"]).alias("detail"),
                    F.when(f["error"].isNull(), b["text"]).alias("value"),
                ),
            )

        return jsonv.let(F.transform(f["params"], settle), keep)

    def last_values(settled: Column) -> Column:
        """A repeated parameter keeps its first place and its last value."""
        keys = F.transform(settled, lambda p: p["key"])
        firsts = F.filter(settled, lambda p, i: F.array_position(keys, p["key"]) == i + 1)

        def newest(p: Column) -> Column:
            same = F.try_element_at(F.filter(settled, lambda q: q["key"] == p["key"]), F.lit(-1))
            return jsonv.let(same, lambda q: F.struct(q["key"].alias("key"), q["kind"].alias("kind"), q["text"].alias("text")))

        return F.transform(firsts, newest)

    df = df.withColumn("_calls", F.transform("_fns", fold)).drop("_fns", "_pending", "_decoded")
    parsed = _outcome(df, ~t.contains(CALL_OPEN), F.lit(False))
    return parsed.withColumn("content", _content(t))


# --- structured calls -------------------------------------------------------


def parse_structured_calls(
    df: DataFrame, tools: Mapping[str, Mapping[str, str]] = TOOLS, calls: str = "tool_calls", content: str = "text"
) -> DataFrame:
    """Check calls already delivered as ``array<struct<id,name,arguments STRING>>``."""
    names = _names(tools)

    def one(c: Column) -> Column:
        args = F.coalesce(c["arguments"], F.lit("{}"))
        error = F.when(~F.array_contains(names, c["name"]), "unknown_function").when(
            jsonv.strict_json(args).isNull(), "structured_bad_json"
        )
        return F.struct(
            error.alias("error"),
            c["name"].alias("name"),
            F.when(error.isNull(), args).alias("args"),
            F.lit(None).cast("string").alias("detail"),
            F.lit(None).cast("string").alias("value"),
        )

    given = F.coalesce(F.col(calls), F.array().cast(df.schema[calls].dataType))
    parsed = _outcome(df.withColumn("_calls", F.transform(given, one)), F.lit(False), F.lit(False))
    parsed = parsed.withColumn("arguments", jsonv.entries(F.col("arguments")))
    return parsed.withColumn("content", F.when(F.col("error_class").isNull(), F.col(content)))


_PARSERS: dict[str, Callable[..., DataFrame]] = {"qwen3_coder": parse_xml_calls, "hermes": parse_hermes_calls}


def register_parser(name: str, fn: Callable[..., DataFrame]) -> None:
    """Add a dialect; ``fn(df, tools)`` must return the audit columns."""
    _PARSERS[name] = fn


def parse_calls(df: DataFrame, parser: str, tools: Mapping[str, Mapping[str, str]] = TOOLS) -> DataFrame:
    """Parse with a registered dialect."""
    if parser not in _PARSERS:
        raise ValueError(f"unknown tool parser {parser!r}, available: {sorted(_PARSERS)}")
    return _PARSERS[parser](df, tools)


# --- audit views ------------------------------------------------------------


# The format hint of the JSON dialect.
HERMES_HINT = 'Expected format:\n<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>'


def error_message(tools: Mapping[str, Mapping[str, str]] = TOOLS, hint: str | None = None) -> Column:
    """Feedback sentence for ``error_class``, with the offending value and what is allowed.

    ``hint`` (``HERMES_HINT``) follows the sentences about a call's form. JSON decoder
    positions are not reproduced.
    """
    # Sentences shown to the model.
    shown = f" {hint}" if hint else ""
    call = F.concat(F.lit("'"), F.col("tool"), F.lit("'"))
    param = F.concat(F.lit("'"), F.col("detail"), F.lit("'"))
    listed = F.create_map(*[F.lit(x) for n in _check(tools) for x in (n, str(list(tools[n])))])[F.col("tool")]
    e = F.col("error_class")

    def wrong(what: str) -> Column:
        return F.concat(F.lit("Invalid action: value '"), F.col("value"), F.lit("' of parameter "), param, F.lit(f" {what} in tool call "), call, F.lit("."))

    return (
        F.when(e == "no_call", f"No function call found in the response.{shown}")
        .when(e == "unclosed_call", f"Unclosed tool call: missing </tool_call>.{shown}")
        .when(e == "too_many_calls", F.format_string("Number of tool calls %d exceeds max_parallel_calls 1.", F.col("n_calls")))
        .when(e == "no_function_name", "Invalid function call format: Cannot find function name.")
        .when(
            e == "unknown_function",
            F.concat(
                F.lit("Invalid action: function "),
                call,
                F.lit(f" is not defined in the tools list.\nAllowed functions should be one of: {_check(tools)}."),
            ),
        )
        .when(e == "no_parameter_name", F.concat(F.lit("Invalid function call format: Cannot find parameter name in tool call "), call, F.lit(".")))
        .when(
            e == "unknown_parameter",
            F.concat(
                F.lit("Invalid action: parameter "), param, F.lit(" is not defined in the parameters for function "), call,
                F.lit(".\nAllowed parameters for function "), call, F.lit(": "), listed, F.lit("."),
            ),
        )
        .when(e == "not_int", wrong("is not an integer"))
        .when(e == "not_float", wrong("is not a float"))
        .when(e == "not_bool", wrong("is not a boolean (`true` of `false`)"))
        .when(e == "bad_literal", wrong("is not valid"))
        .when(e == "bad_json", f"Invalid tool_call JSON.{shown}")
        .when(e == "not_object", F.concat(F.lit("Invalid tool_call: expected a JSON object, got "), F.col("value"), F.lit(f".{shown}")))
        .when(e == "missing_name", f"Invalid tool_call: missing 'name' field.{shown}")
        .when(e == "name_not_string", F.concat(F.lit("Invalid tool_call: 'name' must be a string, got "), F.col("value"), F.lit(".")))
        .when(e == "bad_argument_json", F.concat(F.lit("Invalid arguments JSON for "), call, F.lit(".")))
        .when(e == "arguments_not_object", F.concat(F.lit("Invalid arguments for "), call, F.lit(": expected a JSON object, got "), F.col("value"), F.lit(".")))
        .when(e == "structured_bad_json", F.concat(F.lit("Invalid action: arguments for function "), call, F.lit(" are not valid JSON.")))
    )


def tool_call_errors(parsed: DataFrame) -> DataFrame:
    """Turns per error class and tool; ``ok`` counts clean turns."""
    return parsed.groupBy(
        F.coalesce("error_class", F.lit("ok")).alias("error_class"), F.coalesce("tool", F.lit("")).alias("tool")
    ).agg(F.count("*").alias("n_turns"), F.sum("n_calls").alias("n_calls"))


def argument(name: str) -> Column:
    """Text of one argument, or null."""
    return F.try_element_at(F.filter("arguments", lambda a: a["key"] == name), F.lit(1))["text"]


def render_action(parsed: DataFrame) -> DataFrame:
    """Add ``action``: the shell command line of the parsed call."""

    def flag(a: Column) -> Column:
        return F.concat(F.lit("--"), a["key"], F.lit(" "), shell_quote(jsonv.python_str(a["kind"], a["text"])))

    base = F.try_element_at(F.filter("arguments", lambda a: (a["key"] == "command") & (a["kind"] != "null")), F.lit(1))["text"]
    flags = F.array_join(F.transform(F.filter("arguments", lambda a: a["key"] != "command"), flag), " ")
    words = F.concat_ws(" ", shell_quote(F.col("tool")), shell_quote(base), F.when(flags != "", flags))
    action = (
        F.when(F.col("error_class").isNotNull(), None)
        .when(F.col("tool") == "submit", SUBMIT_ACTION)
        .when(F.col("tool") == "execute_bash", F.coalesce(argument("command"), F.lit("")))
        .otherwise(words)
    )
    return parsed.withColumn("action", action)


def flag_blocked(steps: DataFrame, action: str = "action") -> DataFrame:
    """Add ``blocked``: the first word of the command is on the blocked list."""
    first = F.get(py_words(F.col(action)), F.lit(0))
    return steps.withColumn("blocked", F.coalesce(first.isin(BLOCKED_COMMANDS), F.lit(False)))


def parse_list_arg(df: DataFrame, value: str, out: str) -> DataFrame:
    """Add a list argument as ``array<string>``: JSON list, else Python list, else one element."""
    v = F.coalesce(F.col(value), F.lit(""))
    is_list = F.coalesce(jsonv.json_kind(jsonv.strict_json(v)) == "array", F.lit(False))
    waiting = F.when((v != "") & ~is_list, F.array(v)).otherwise(F.array().cast("array<string>"))
    decoded = df.withColumn("_lit", literals_to_json(waiting))
    from_py = F.get("_lit", F.lit(0))
    source = F.when(is_list, v).when(jsonv.json_kind(jsonv.strict_json(from_py)) == "array", from_py)
    texts = F.from_json(source, "array<string>")
    kinds = jsonv.strict_json(source).cast("array<variant>")
    items = F.transform(
        texts, lambda t, i: jsonv.python_str(jsonv.json_kind(F.get(kinds, i)), F.coalesce(t, F.lit("null")))
    )
    empty = F.array().cast("array<string>")
    return decoded.withColumn(out, F.when(v == "", empty).when(source.isNull(), F.array(v)).otherwise(items)).drop("_lit")
