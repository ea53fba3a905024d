"""Long texts, each group of operators in a JVM of its own: interpreted code has the deepest frames."""

import ast
import json
import os
import pathlib
import random
import re
import subprocess
import sys

from pyspark.sql import functions as F

from rolloom.functions.text import PUNCTUATION, spaced_json
from rolloom.operators import toolcalls as tc

ROOT = pathlib.Path(__file__).resolve().parent.parent
START = """
import sys
from pyspark.sql import SparkSession, functions as F
conf = {"spark.master": "local[2]", "spark.driver.memory": "6g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": sys.argv[1], "spark.sql.execution.arrow.maxRecordsPerBatch": "4"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
"""


def fresh(script, folder):
    """Run a script in a new process, and thus a new JVM; returns what it prints."""
    env = os.environ | {"PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", START + script, str(folder)], capture_output=True, text=True, env=env, timeout=240, cwd=folder)
    assert done.returncode == 0, done.stderr[-3000:]
    return done.stdout.split("RESULT ")[-1]


def test_spaced_json_equals_the_library(spark):
    rng = random.Random(5)

    def value(depth):
        kind = rng.randint(0, 7 if depth else 4)
        text = "".join(rng.choice('\\"",:[]{} aé\n\t\x7f/😀 ') for _ in range(rng.randint(0, 9)))
        return [text, rng.randint(-99, 99), None, True, text][kind] if kind < 5 else [value(depth - 1) for _ in range(rng.randint(0, 4))] if kind < 7 else {f"{text}{i}": value(depth - 1) for i in range(rng.randint(0, 4))}

    values = [value(4) for _ in range(500)] + ["\\", '\\"', '"\\\\"', ["\\\\", '"', ",:"], {"a\\": {'"': ":,"}}]
    rows = [(i, json.dumps(v, separators=(",", ":"), ensure_ascii=bool(i % 2))) for i, v in enumerate(values)]
    got = spark.createDataFrame(rows, "i int, t string").select("i", spaced_json(F.col("t")).alias("s")).collect()
    assert [r["s"] for r in sorted(got)] == [json.dumps(v, ensure_ascii=bool(i % 2)) for i, v in enumerate(values)]


def test_number_patterns_equal_python(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("12_.eE+- ") for _ in range(rng.randint(1, 8))) for _ in range(3000)] + ["1", "1_0", "1__0", "_1", "1_", "1.", ".5", "1._5", "1_.5", "1e5", "1e_5", "1_0e1_0", "١_2", " 7 ", "1\n", ""]

    def reads(kind, text):
        try:
            kind(text)
        except ValueError:
            return False
        return True

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = sorted(df.select("i", tc._is_number(F.col("t"), tc._INT).alias("a"), tc._is_number(F.col("t"), tc._FLOAT).alias("b")).collect())
    wrong = [(texts[r["i"]], r["a"], r["b"]) for r in got if (r["a"], r["b"]) != (reads(int, texts[r["i"]]), reads(float, texts[r["i"]]))]
    assert not wrong


def test_calls_with_ten_megabytes(tmp_path):
    got = fresh(
        """
from rolloom.operators import toolcalls as tc, trajectories as tj
n = 10_000_000
plain, quotes = "x" * n, '\\\\"' * (n // 2)
def nested(s):
    return '{"query_list":["' + s + '",{"a":1,"b":[2]}]}'
calls = "i int, text string, tool_calls array<struct<id:string,name:string,arguments:string>>"
rows = [(i, "c", [("1", "search", nested(s))]) for i, s in enumerate([plain, quotes, ",:" * (n // 2)])]
parsed = tc.render_action(tc.parse_structured_calls(spark.createDataFrame(rows, calls), tc.TOOLS))
a = [(r["e"], r["n"], r["end"]) for r in parsed.orderBy("i").select(F.col("error_class").alias("e"), F.length("action").alias("n"), F.right("action", F.lit(24)).alias("end")).collect()]
xml = lambda tool, key, value: f"<tool_call>\\n<function={tool}>\\n<parameter={key}>\\n{value}\\n</parameter>\\n</function>\\n</tool_call>"
rows = [(0, xml("search", "topk", "1" + "_1" * 5000)), (1, xml("search", "topk", "1" + "_1" * (n // 2) + "x")), (2, xml("search", "query_list", '["' + plain + '"]')), (3, xml("execute_bash", "command", "echo " + plain))]
parsed = tc.render_action(tc.parse_xml_calls(spark.createDataFrame(rows, "i int, text string")))
b = [(r["error_class"], r["n"]) for r in parsed.orderBy("i").select("error_class", F.length("action").alias("n")).collect()]
tools = {"t": {"x": "number"}}
rows = [(0, xml("t", "x", "1" * 300 + "_1" * 5000)), (1, xml("t", "x", "1_" * (n // 2))), (2, xml("t", "x", "1" * n))]
c = [r["error_class"] for r in tc.parse_xml_calls(spark.createDataFrame(rows, "i int, text string"), tools).orderBy("i").select("error_class").collect()]
reply = '<tool_call>{"name": "finish", "arguments": {"answer": ["' + plain + '", 1]}}</tool_call>'
steps = spark.createDataFrame([("r", 0, 0, "finished", reply, "o")], "run_id string, step_idx int, ord int, exit_reason string, response string, observation string")
d = tj.extract_answer(steps).select(F.length("answer").alias("n")).first()["n"]
print("RESULT", (a, b, c, d))
""",
        tmp_path,
    )
    structured, xml, numbers, answer = ast.literal_eval(got)
    n = 10_000_000
    tail = '", {"a": 1, "b": [2]}]' + "'"
    assert [e for e, _, _ in structured] == [None] * 3 and all(end.endswith(tail) for _, _, end in structured)
    assert [m for _, m, _ in structured] == [n + len("search --query_list '[\"" + tail)] * 3
    assert [e for e, _ in xml] == [None, "not_int", None, None]
    assert xml[0][1] == len("search --topk ") + 5001 and xml[3][1] == n + 5
    assert numbers == ["not_float"] * 3 and answer == n + len('["", 1]')


def test_no_pattern_repeats_a_group():
    """The JVM matches a repeated group by recursion, one frame per repetition."""
    found = []
    for path in sorted((ROOT / "rolloom").rglob("*.py")):
        if "llm" in path.parts or "plans" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.Constant) and isinstance(node.value, str) and node.value != PUNCTUATION and re.search(r"(?<!\\)\)(?:[*+]|\{\d)", node.value):
                found.append((path.name, node.lineno, node.value[:80]))
    assert not found
