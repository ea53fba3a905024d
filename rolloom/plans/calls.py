"""Tool-call queries over transcripts derived from ``conversations``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom.operators import toolcalls, trajectories, rewards, reports
from rolloom.plans.registry import as_long, query, table

_LOW = "abcdefghijklmnopqrstuvwxyz"


def n_items(spark: SparkSession, sf_dir: str) -> int:
    """How many benchmark items there are; ids run from 0."""
    return table(spark, sf_dir, "benchmark").count()


def _tag(body: Column) -> Column:
    return F.concat(F.lit("<tool_call>\n"), body, F.lit("\n</tool_call>"))


def _call(name: str, key: str, value: Column) -> Column:
    """JSON of a call with one argument, in a fixed key order."""
    arg = F.to_json(F.struct(value.alias(key)))
    return F.concat(F.lit(f'{{"name":"{name}","arguments":'), arg, F.lit("}"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn with its whole text as thought, followed by one of eight call shapes.

    The answer of a call is the whole text of the conversation's benchmark item.
    """
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    gold = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("gold"))
    t = turns.withColumn("item_id", F.col("conv_id") % n_items(spark, sf_dir)).join(gold, "item_id")
    loud = F.concat(F.lit("The "), F.translate("gold", _LOW, _LOW.upper()), F.lit("!!"))
    finish = _tag(_call("finish", "answer", F.col("gold")))
    xml = F.concat(F.lit("<tool_call>\n<function=finish>\n<parameter=answer>\n"), F.col("gold"), F.lit("\n</parameter>\n</function>\n</tool_call>"))
    shape = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(8))
    call = (
        F.when(shape == 0, finish)
        .when(shape == 1, _tag(_call("finish", "answer", loud)))
        .when(shape == 2, xml)
        .when(shape == 3, F.lit(""))
        .when(shape == 4, F.concat(finish, finish))
        .when(shape == 5, F.concat(F.lit("<tool_call>"), _call("finish", "answer", F.col("gold"))))
        .when(shape == 6, _tag(F.concat(F.lit('{"name":'), F.col("gold"))))
        .otherwise(_tag(_call("look_up", "answer", F.col("gold"))))
    )
    return t.select(
        F.col("conv_id").alias("run_id"), "turn", "gold", "item_id", shape.alias("shape"), F.concat(F.col("text"), F.lit("\n"), call).alias("text")
    )


def _sql_call(name: str, answer: str) -> str:
    """SQL text of a call's JSON."""
    return f"""('{{"name":"{name}","arguments":' || CAST(json_object('answer', {answer}) AS VARCHAR) || '}}')"""


def _sql_tag(body: str) -> str:
    """SQL text of a tagged call."""
    return f"('<tool_call>' || chr(10) || {body} || chr(10) || '</tool_call>')"


_FIN = _sql_call("finish", "gold")
_LOUD = f"'The ' || translate(gold, '{_LOW}', '{_LOW.upper()}') || '!!'"
TRANSCRIPTS_SQL = f"""
transcripts AS (
  SELECT conv_id AS run_id, turn, gold, item_id, shape,
    text || chr(10) || CASE shape
      WHEN 0 THEN {_sql_tag(_FIN)}
      WHEN 1 THEN {_sql_tag(_sql_call("finish", _LOUD))}
      WHEN 2 THEN '<tool_call>' || chr(10) || '<function=finish>' || chr(10) || '<parameter=answer>' || chr(10) || gold
                  || chr(10) || '</parameter>' || chr(10) || '</function>' || chr(10) || '</tool_call>'
      WHEN 3 THEN ''
      WHEN 4 THEN {_sql_tag(_FIN)} || {_sql_tag(_FIN)}
      WHEN 5 THEN '<tool_call>' || {_FIN}
      WHEN 6 THEN {_sql_tag("""'{"name":' || gold""")}
      ELSE {_sql_tag(_sql_call("look_up", "gold"))} END AS text
  FROM (SELECT c.conv_id, c.turn, c.text, b.text AS gold, b.item_id, (c.conv_id + c.turn) % 8 AS shape
        FROM conversations c JOIN benchmark b ON b.item_id = c.conv_id % (SELECT count(*) FROM benchmark) WHERE c.role = 'assistant'))
"""

# Hermes outcome of the eight shapes, decided by the text alone
_HERMES_SQL = f"""
WITH {TRANSCRIPTS_SQL},
raws AS (SELECT *, regexp_extract_all(text, '(?s)<tool_call>\\s*(.*?)\\s*</tool_call>', 1) AS raws FROM transcripts),
calls AS (SELECT *, len(raws) AS n,
   list_transform(raws, lambda r: CASE WHEN NOT json_valid(r) THEN 'bad_json'
      WHEN json_type(r) <> 'OBJECT' THEN 'not_object'
      WHEN json_extract_string(r, '$.name') NOT IN ('execute_bash','finish','search','search_arxiv','str_replace_editor','submit') THEN 'unknown_function'
      ELSE 'ok' END) AS e,
   list_transform(raws, lambda r: CASE WHEN json_valid(r) THEN json_extract_string(r, '$.name') END) AS names FROM raws),
audit AS (SELECT run_id, turn, text, item_id,
   CASE WHEN NOT contains(text, '<tool_call>') THEN 'no_call' WHEN NOT contains(text, '</tool_call>') THEN 'unclosed_call'
        WHEN n = 0 THEN 'no_call'
        WHEN len(list_filter(e, lambda x: x <> 'ok')) > 0 THEN list_filter(e, lambda x: x <> 'ok')[1]
        WHEN n > 1 THEN 'too_many_calls' ELSE 'ok' END AS error_class,
   CASE WHEN contains(text, '<tool_call>') AND contains(text, '</tool_call>') THEN n ELSE 0 END AS n_calls,
   names, raws, e FROM calls)
"""


@query(
    "toolcall_hermes_audit",
    _HERMES_SQL
    + """
SELECT error_class, tool, count(*) AS n_turns, CAST(sum(n_calls) AS BIGINT) AS n_calls FROM (
  SELECT error_class, n_calls, coalesce(CASE WHEN error_class = 'ok' THEN names[1]
     WHEN error_class IN ('unknown_function') THEN list_extract(names, list_position(e, error_class)) END, '') AS tool FROM audit)
GROUP BY 1, 2""",
)
def toolcall_hermes_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.tool_call_errors(toolcalls.parse_hermes_calls(transcripts(spark, sf_dir)))


@query(
    "toolcall_hermes_turns",
    _HERMES_SQL
    + """
SELECT run_id, turn, CASE WHEN error_class <> 'ok' THEN error_class END AS error_class, n_calls,
  CASE WHEN error_class = 'ok' THEN split_part(text, '<tool_call>', 1) END AS content,
  CASE WHEN error_class = 'ok' THEN json_extract_string(raws[1], '$.arguments.answer') END AS answer,
  CASE error_class WHEN 'no_call' THEN 'No function call found in the response. ' || hint
    WHEN 'unclosed_call' THEN 'Unclosed tool call: missing </tool_call>. ' || hint
    WHEN 'too_many_calls' THEN 'Number of tool calls ' || n_calls || ' exceeds max_parallel_calls 1.'
    WHEN 'bad_json' THEN 'Invalid tool_call JSON. ' || hint
    WHEN 'unknown_function' THEN 'Invalid action: function ''look_up'' is not defined in the tools list.' || chr(10)
      || 'Allowed functions should be one of: [''execute_bash'', ''finish'', ''search'', ''search_arxiv'', ''str_replace_editor'', ''submit''].'
    END AS error_message
FROM audit, (SELECT 'Expected format:' || chr(10) || '<tool_call>' || chr(10) || '{"name": <function-name>, "arguments": <args-json-object>}' || chr(10) || '</tool_call>' AS hint)""",
)
def toolcall_hermes_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = toolcalls.parse_hermes_calls(transcripts(spark, sf_dir))
    shown = parsed.select(
        "run_id", "turn", "error_class", "n_calls", "content", toolcalls.argument("answer").alias("answer"), toolcalls.error_message(hint=toolcalls.HERMES_HINT).alias("error_message")
    )
    return as_long(shown, "n_calls")


def xml_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as an XML call whose parameter types cycle through all kinds."""
    t = table(spark, sf_dir, "conversations")
    shape = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(8))
    query_ = F.to_json(F.array("text", "role"))
    def par(k: str, v: Column) -> Column:
        return F.concat(F.lit(f"<parameter={k}>\n"), v, F.lit("\n</parameter>\n"))
    n = F.col("turn").cast("string")
    body = (
        F.when(shape == 0, F.concat(F.lit("search>\n"), par("command", F.lit("search")), par("query_list", query_), par("topk", F.concat(F.lit(" 0"), n))))
        .when(shape == 1, F.concat(F.lit("search>\n"), par("command", F.lit("search")), par("topk", F.concat(n, F.lit(".5")))))
        .when(shape == 2, F.concat(F.lit("execute_bash>\n"), par("command", F.col("text"))))
        .when(shape == 3, F.concat(F.lit("execute_bash>\n"), par("cmd", F.col("text"))))
        .when(shape == 4, F.concat(F.lit("finish>\n"), par("answer", F.lit("NULL"))))
        .when(shape == 5, F.concat(F.lit("look_up>\n"), par("answer", F.col("text"))))
        .when(shape == 6, F.concat(F.lit("search>\n"), par("query_list", F.concat(F.lit("["), F.col("text"))), par("topk", n)))
        .otherwise(F.concat(F.lit("submit>\n"), par("note", F.col("text"))))
    )
    text = F.concat(F.col("text"), F.lit("\n<tool_call>\n<function="), body, F.lit("</function>\n</tool_call>"))
    return t.select(F.col("conv_id").alias("run_id"), "turn", shape.alias("shape"), text.alias("text"))


_XML_TEXT_SQL = """
x AS (SELECT conv_id AS run_id, turn, text || chr(10) || '<tool_call>' || chr(10) || '<function=' || CASE (conv_id + turn) % 8
    WHEN 0 THEN 'search>\n<parameter=command>\nsearch\n</parameter>\n<parameter=query_list>\n' || CAST(json_array(text, role) AS VARCHAR) || '\n</parameter>\n<parameter=topk>\n 0' || turn
    WHEN 1 THEN 'search>\n<parameter=command>\nsearch\n</parameter>\n<parameter=topk>\n' || turn || '.5' WHEN 2 THEN 'execute_bash>\n<parameter=command>\n' || text
    WHEN 3 THEN 'execute_bash>\n<parameter=cmd>\n' || text WHEN 4 THEN 'finish>\n<parameter=answer>\nNULL' WHEN 5 THEN 'look_up>\n<parameter=answer>\n' || text
    WHEN 6 THEN 'search>\n<parameter=query_list>\n[' || text || '\n</parameter>\n<parameter=topk>\n' || turn ELSE 'submit>\n<parameter=note>\n' || text END
    || '\n</parameter>\n</function>\n</tool_call>' AS t FROM conversations),
c AS (SELECT *, regexp_extract(t, '(?s)<tool_call>\n<function=(.*?)</function>', 1) AS body FROM x),
p AS (SELECT *, split_part(body, '>', 1) AS tool, regexp_extract_all(body, '(?s)<parameter=([^>]*)>', 1) AS keys, regexp_extract_all(body, '(?s)<parameter=[^>]*>\n(.*?)\n</parameter>', 1) AS raw FROM c),
a AS (SELECT *, unnest(range(1, len(keys) + 1)) AS i FROM p),
typed AS (SELECT run_id, turn, i, keys[i] AS key, raw[i] AS v, tool IN ('execute_bash', 'finish', 'search', 'search_arxiv', 'str_replace_editor', 'submit') AS known,
  CASE WHEN tool = 'submit' THEN 'string' WHEN tool = 'search' AND keys[i] = 'topk' THEN 'integer' WHEN tool = 'search' AND keys[i] IN ('query_list', 'url_list') THEN 'array'
    WHEN (tool = 'search' OR tool = 'execute_bash') AND keys[i] = 'command' OR tool = 'finish' AND keys[i] = 'answer' THEN 'string' END AS kind FROM a),
graded AS (SELECT *, CASE WHEN NOT known THEN 'unknown_function' WHEN lower(v) = 'null' THEN NULL WHEN kind IS NULL THEN 'unknown_parameter'
  WHEN kind = 'integer' AND NOT regexp_matches(v, '^\\s*[+-]?\\d+\\s*$') THEN 'not_int' WHEN kind = 'array' AND NOT json_valid(v) THEN 'bad_literal' END AS e FROM typed),
shown AS (SELECT *, CASE WHEN lower(v) = 'null' THEN 'null' WHEN kind = 'integer' THEN 'int' WHEN kind = 'array' THEN lower(json_type(v)) ELSE 'string' END AS k,
  CASE WHEN lower(v) = 'null' THEN 'null' WHEN kind = 'integer' THEN CAST(CAST(trim(v) AS BIGINT) AS VARCHAR) WHEN kind = 'array' THEN CAST(CAST(v AS JSON) AS VARCHAR) ELSE v END AS s FROM graded WHERE e IS NULL),
calls AS (SELECT run_id, turn, arg_min(e, i) FILTER (e IS NOT NULL) AS error_class, arg_min(key, i) FILTER (e IS NOT NULL AND e <> 'unknown_function') AS detail FROM graded GROUP BY ALL),
args AS (SELECT run_id, turn, string_agg(key, '|' ORDER BY i) AS keys, string_agg(k, '|' ORDER BY i) AS kinds, string_agg(s, '|' ORDER BY i) AS vals FROM shown GROUP BY ALL)"""


@query(
    "toolcall_xml_args",
    f"""WITH {_XML_TEXT_SQL}
SELECT p.run_id, p.turn, error_class, tool, detail, CASE WHEN error_class IS NULL THEN args.keys END AS keys, CASE WHEN error_class IS NULL THEN kinds END AS kinds,
  CASE WHEN error_class IS NULL THEN vals END AS vals, CASE WHEN error_class IS NULL THEN split_part(t, '<tool_call>', 1) END AS content
FROM p JOIN calls USING (run_id, turn) LEFT JOIN args USING (run_id, turn)""",
)
def toolcall_xml_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = toolcalls.parse_xml_calls(xml_transcripts(spark, sf_dir))
    def joined(field: str) -> Column:
        return F.when(F.col("arguments").isNotNull(), F.array_join(F.transform("arguments", lambda a: a[field]), "|"))
    return p.select(
        "run_id", "turn", "error_class", "tool", "detail", joined("key").alias("keys"), joined("kind").alias("kinds"), joined("text").alias("vals"), "content"
    )


@query(
    "toolcall_feedback",
    """
WITH t AS (SELECT *, (conv_id + turn) % 8 AS shape FROM conversations)
SELECT conv_id AS run_id, turn, CASE shape
  WHEN 1 THEN 'Invalid action: value ''' || turn || '.5'' of parameter ''topk'' is not an integer in tool call ''search''.'
  WHEN 3 THEN 'Invalid action: parameter ''cmd'' is not defined in the parameters for function ''execute_bash''.' || chr(10) || 'Allowed parameters for function ''execute_bash'': [''command''].'
  WHEN 5 THEN 'Invalid action: function ''look_up'' is not defined in the tools list.' || chr(10)
    || 'Allowed functions should be one of: [''execute_bash'', ''finish'', ''search'', ''search_arxiv'', ''str_replace_editor'', ''submit''].'
  ELSE 'Invalid action: value ''[' || text || ''' of parameter ''query_list'' is not valid in tool call ''search''.' END AS error_message
FROM t WHERE shape IN (1, 3, 5, 6)""",
)
def toolcall_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence that each failing XML turn is answered with."""
    p = toolcalls.parse_xml_calls(xml_transcripts(spark, sf_dir))
    return p.where(F.col("error_class").isNotNull()).select("run_id", "turn", toolcalls.error_message().alias("error_message"))


#: Tools with a number and a switch, for calls with wrong values of these types.
MEASURES = {"measure": {"x": "number", "on": "boolean"}, "search": toolcalls.TOOLS["search"]}

# the same text in both engines: what kind of call a turn makes, from its numbers and role
_BROKEN_SQL = """
b AS (SELECT conv_id AS run_id, turn, role, CASE (conv_id + turn) % 9
  WHEN 0 THEN '<tool_call>' || chr(10) || '<function=' || role || chr(10) || '</function></tool_call>'
  WHEN 1 THEN '<tool_call>' || chr(10) || '<function=search>' || chr(10) || '<parameter=' || role || '</parameter></function></tool_call>'
  WHEN 2 THEN '<tool_call>' || chr(10) || '<function=measure>' || chr(10) || '<parameter=x>' || chr(10) || turn || ' m' || chr(10) || '</parameter></function></tool_call>'
  WHEN 3 THEN '<tool_call>' || chr(10) || '<function=measure>' || chr(10) || '<parameter=on>' || chr(10) || 'Maybe ' || role || chr(10) || '</parameter></function></tool_call>'
  WHEN 4 THEN '<tool_call>{"arguments": {"topk": ' || turn || '}}</tool_call>' WHEN 5 THEN '<tool_call>{"name": ' || CASE WHEN turn % 2 = 0 THEN '7' ELSE '["' || role || '"]' END || ', "arguments": {}}</tool_call>'
  WHEN 6 THEN '<tool_call>{"name": "search", "arguments": "{' || role || '"}</tool_call>' WHEN 7 THEN '<tool_call>{"name": "search", "arguments": [' || turn || ']}</tool_call>'
  ELSE '{"topk": ' || role || '}' END AS text FROM conversations)"""


def broken_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call with one mistake per turn, in one of the three forms."""
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(9))
    role, turn = F.col("role"), F.col("turn").cast("string")
    joined = lambda parts: [F.lit(x) if isinstance(x, str) else x for x in parts]
    xml = lambda *inner: F.concat(F.lit("<tool_call>\n"), *joined(inner), F.lit("</function></tool_call>"))
    js = lambda *inner: F.concat(F.lit("<tool_call>"), *joined(inner), F.lit("</tool_call>"))
    named = F.when(F.pmod("turn", F.lit(2)) == 0, F.lit("7")).otherwise(F.concat(F.lit('["'), role, F.lit('"]')))
    text = (
        F.when(kind == 0, xml("<function=", role, "\n"))
        .when(kind == 1, xml("<function=search>\n<parameter=", role, "</parameter>"))
        .when(kind == 2, xml("<function=measure>\n<parameter=x>\n", turn, " m\n</parameter>"))
        .when(kind == 3, xml("<function=measure>\n<parameter=on>\nMaybe ", role, "\n</parameter>"))
        .when(kind == 4, js('{"arguments": {"topk": ', turn, "}}"))
        .when(kind == 5, js('{"name": ', named, ', "arguments": {}}'))
        .when(kind == 6, js('{"name": "search", "arguments": "{', role, '"}'))
        .when(kind == 7, js('{"name": "search", "arguments": [', turn, "]}"))
        .otherwise(F.concat(F.lit('{"topk": '), role, F.lit("}")))
    )
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), "turn", text.alias("text"))


@query(
    "call_feedback",
    f"""WITH {_BROKEN_SQL},
j AS (SELECT *, CASE WHEN contains(text, '<tool_call>{{') THEN regexp_extract(text, '<tool_call>(.*)</tool_call>', 1, 's') WHEN text LIKE '{{%' THEN text END AS js,
  regexp_extract(text, '<function=([a-z]+)>', 1) AS fn, regexp_extract(text, '<parameter=([a-z]+)>', 1) AS pm, regexp_extract(text, '<parameter=[a-z]+>\\n([^<]*)\\n</parameter>', 1) AS pv FROM b),
k AS (SELECT *, CASE WHEN json_valid(js) THEN json_type(js, '$.name') END AS nt, CASE WHEN json_valid(js) THEN json_type(js, '$.arguments') END AS ak FROM j)
SELECT run_id, turn, CASE
  WHEN js IS NULL AND fn = '' THEN 'Invalid function call format: Cannot find function name.'
  WHEN js IS NULL AND pm = '' THEN 'Invalid function call format: Cannot find parameter name in tool call ''' || fn || '''.'
  WHEN js IS NULL AND pm = 'x' AND TRY_CAST(pv AS DOUBLE) IS NULL THEN 'Invalid action: value ''' || pv || ''' of parameter ''x'' is not a float in tool call ''' || fn || '''.'
  WHEN js IS NULL AND pm = 'on' AND lower(pv) NOT IN ('true', 'false') THEN 'Invalid action: value ''' || lower(pv) || ''' of parameter ''on'' is not a boolean (`true` of `false`) in tool call ''' || fn || '''.'
  WHEN NOT json_valid(js) THEN 'Invalid action: arguments for function ''search'' are not valid JSON.'
  WHEN nt IS NULL THEN 'Invalid tool_call: missing ''name'' field.'
  WHEN nt <> 'VARCHAR' THEN 'Invalid tool_call: ''name'' must be a string, got ' || CASE nt WHEN 'ARRAY' THEN 'list' ELSE 'int' END || '.'
  WHEN ak = 'VARCHAR' AND NOT json_valid(json_extract_string(js, '$.arguments')) THEN 'Invalid arguments JSON for ''' || json_extract_string(js, '$.name') || '''.'
  WHEN ak <> 'OBJECT' THEN 'Invalid arguments for ''' || json_extract_string(js, '$.name') || ''': expected a JSON object, got ' || CASE ak WHEN 'ARRAY' THEN 'list' ELSE 'str' END || '.' END AS error_message
FROM k""",
)
def call_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence each broken call is answered with, by the parser of its form."""
    broken = broken_calls(spark, sf_dir)
    is_xml, is_json = F.col("text").contains("<function="), F.col("text").startswith("<tool_call>{")
    call = F.array(F.struct(F.lit("c").alias("id"), F.lit("search").alias("name"), F.col("text").alias("arguments")))
    parsed = [
        toolcalls.parse_xml_calls(broken.where(is_xml), MEASURES),
        toolcalls.parse_hermes_calls(broken.where(is_json), MEASURES),
        toolcalls.parse_structured_calls(broken.where(~is_xml & ~is_json).withColumn("tool_calls", call), MEASURES),
    ]
    told = [p.select("run_id", "turn", toolcalls.error_message(MEASURES).alias("error_message")) for p in parsed]
    return told[0].union(told[1]).union(told[2])


@query(
    "toolcall_actions",
    """
WITH t AS (SELECT *, (conv_id + turn) % 5 AS shape, lag(1) OVER (PARTITION BY conv_id ORDER BY turn) AS x FROM conversations),
q AS (SELECT *, CASE WHEN text = '' THEN '''''' WHEN regexp_matches(text, '[^A-Za-z0-9_@%+=:,./-]') THEN '''' || replace(text, '''', '''"''"''') || '''' ELSE text END AS qt FROM t)
SELECT conv_id AS run_id, turn, CASE WHEN shape = 4 THEN 'unknown_function' END AS error_class,
  CASE shape WHEN 0 THEN 'finish --answer ' || qt WHEN 1 THEN 'git ' || text WHEN 2 THEN 'echo ''<<<Finished>>>'''
     WHEN 3 THEN 'search search --topk ' || turn || ' --query_list ''' || replace('["' || role || '", ' || CAST(to_json(text) AS VARCHAR) || ']', '''', '''"''"''') || '''' END AS action,
  shape = 1 AS blocked,
  '[' || CASE shape WHEN 3 THEN role || ', ' || text ELSE '' END || ']' AS query_list
FROM q""",
)
def toolcall_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    shape = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5))
    name = (
        F.when(shape == 0, "finish").when(shape == 1, "execute_bash").when(shape == 2, "submit").when(shape == 3, "search").otherwise("look_up")
    )
    args = (
        F.when(shape == 0, F.to_json(F.struct(F.col("text").alias("answer"))))
        .when(shape == 1, F.to_json(F.struct(F.concat(F.lit("git "), F.col("text")).alias("command"))))
        .when(shape == 3, F.to_json(F.struct(F.col("turn").alias("topk"), F.lit("search").alias("command"), F.array("role", "text").alias("query_list"))))
        .otherwise(F.lit("{}"))
    )
    calls = t.select(
        F.col("conv_id").alias("run_id"), "turn", "text",
        F.array(F.struct(F.lit("call").alias("id"), name.alias("name"), args.alias("arguments"))).alias("tool_calls"),
    )
    p = toolcalls.flag_blocked(toolcalls.render_action(toolcalls.parse_structured_calls(calls)))
    p = toolcalls.parse_list_arg(p.withColumn("_q", toolcalls.argument("query_list")), "_q", "_list")
    shown = F.concat(F.lit("["), F.array_join("_list", ", "), F.lit("]"))
    return p.select("run_id", "turn", "error_class", "action", "blocked", shown.alias("query_list"))


_NORM = """array_to_string(list_filter(string_split_regex(translate(array_to_string(list_transform(
   regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'),
   lambda w: CASE WHEN w IN ('a', 'an', 'the') THEN ' ' ELSE w END), ''), '!"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', ''), '\\s+'), lambda w: w <> ''), ' ')"""

_SCORES_SQL = (
    _HERMES_SQL
    + """,
steps AS (SELECT a.run_id, a.turn, t.gold, CASE WHEN error_class = 'ok' THEN json_extract_string(raws[1], '$.arguments.answer') END AS answer
   FROM audit a JOIN transcripts t USING (run_id, turn)),
answers AS (SELECT run_id, arg_max(answer, turn) FILTER (answer IS NOT NULL) AS answer, any_value(gold) AS gold FROM steps GROUP BY run_id),
scored AS (SELECT run_id, answer, CASE WHEN answer IS NOT NULL AND """
    + _NORM.format(x="answer")
    + " = "
    + _NORM.format(x="gold")
    + " THEN 1e0 ELSE 0e0 END AS score FROM answers)"
)


def scored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts -> parsed calls -> steps -> last answer -> exact-match score per run."""
    parsed = toolcalls.parse_hermes_calls(transcripts(spark, sf_dir))
    steps = parsed.select(
        "run_id",
        F.col("turn").alias("step_idx"),
        F.lit(0).alias("ord"),
        F.col("text").alias("response"),
        F.lit(None).cast("string").alias("observation"),
        F.when(F.col("error_class").isNotNull(), "format_error").when(F.col("tool") == "finish", "finished").otherwise("completed").alias("exit_reason"),
    )
    answers = trajectories.extract_answer(steps)
    gold = table(spark, sf_dir, "benchmark").select("item_id", F.array("text").alias("targets"))
    runs = answers.withColumn("item_id", F.col("run_id") % n_items(spark, sf_dir)).join(gold, "item_id")
    return rewards.score_search(runs.select("run_id", "answer"), runs.select("run_id", "targets"))


@query("search_scores", _SCORES_SQL + " SELECT run_id, answer, score FROM scored")
def search_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_runs(spark, sf_dir).select("run_id", "answer", "score")


@query(
    "final_answer_score",
    _SCORES_SQL
    + """,
per_task AS (SELECT run_id % (SELECT count(*) FROM benchmark) AS item_id, avg(score) AS r, count(*) AS n FROM scored GROUP BY 1)
SELECT round(avg(r), 9) AS avg_at_n, count(*) AS n_tasks, min(n) AS min_n, max(n) AS max_n FROM per_task""",
)
def final_answer_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scored_runs(spark, sf_dir).withColumn("item_id", F.col("run_id") % n_items(spark, sf_dir))
    return reports.avg_at_n(scored, "item_id").withColumn("avg_at_n", F.round("avg_at_n", 9))
