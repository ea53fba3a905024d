from pyspark.sql import functions as F

from rolloom.operators import trajectories as tj
from tests.conftest import by


def test_clean_observation(spark):
    df = spark.createDataFrame([(0, "\x1b[31m \r\n"), (1, "ok\r\n"), (2, "x" * 30)], "i int, t string")
    got = by(df.select("i", tj.clean_observation(F.col("t"), 10).alias("o"), tj.clean_observation(F.col("t"), 10, strict=False).alias("p")), "i")
    assert got[0]["o"] == tj.EMPTY_OBSERVATION
    assert got[1]["o"] == "Observation:\nok\n"
    assert got[2]["o"].startswith("Observation:\nxxxxxxxxxx<response clipped>\n<NOTE>")
    assert "-20 characters were elided" in got[2]["o"] and " 20 characters were elided" in got[2]["p"]


STEPS = "run_id string, step_idx int, over_budget boolean, parse_error boolean, env_error string, tool string"


def test_outcomes_and_timeout_budget(spark):
    rows = [("a", i, False, False, "timeout", "search") for i in range(1, 6)]
    rows += [("b", 1, False, True, None, None), ("b", 2, False, False, "syntax", "search"), ("b", 3, False, False, None, "search"), ("b", 4, False, False, None, "submit")]
    rows += [("c", 1, True, None, None, None), ("d", 1, None, None, "dead", "search")]
    got = by(tj.classify_steps(spark.createDataFrame(rows, STEPS)), "run_id", "step_idx")
    assert [got["a", i]["done"] for i in range(1, 6)] == [False, False, False, True, True]
    assert [got["b", i]["exit_reason"] for i in range(1, 5)] == ["format_error", "syntax_error", "completed", "finished"]
    assert got["c", 1]["exit_reason"] == "token_limit" and got["c", 1]["done"]
    assert got["d", 1]["exit_reason"] == "terminal_not_alive" and got["d", 1]["done"]


def test_episode_end(spark):
    schema = "run_id string, step_idx int, exit_reason string, done boolean, tool string"
    rows = [("a", 1, "completed", False, "s"), ("a", 2, "finished", True, "f"), ("a", 3, "completed", False, "s")]
    rows += [("b", i, "completed", False, "s") for i in range(1, 6)]
    rows += [("c", 1, "completed", False, "s"), ("c", 2, "completed", False, "s"), ("c", 3, "finished", True, "f")]
    rows += [("d", 1, "unknown_error", False, None), ("d", 2, "completed", False, "s")]
    df = spark.createDataFrame(rows, schema)
    out = [(r.run_id, r.step_idx, r.ord, r.exit_reason) for r in tj.close_episodes(df, 3).collect()]
    assert sorted(x for x in out if x[0] == "a") == [("a", 1, 0, "completed"), ("a", 2, 0, "finished")]
    assert ("b", 3, 1, "max_step_limit") in out and not any(x[0] == "b" and x[1] > 3 for x in out)
    assert ("c", 3, 0, "finished") in out and ("c", 3, 1, "max_step_limit") in out
    assert [x for x in out if x[0] == "d"] == [("d", 1, 0, "unknown_error")]
    relaxed = [(r.run_id, r.exit_reason) for r in tj.close_episodes(df, 3, strict=False).collect()]
    assert ("c", "max_step_limit") not in relaxed and ("b", "max_step_limit") in relaxed


TURNS = "run_id string, turn int, kind string, ids array<bigint>, logprobs array<double>"


def test_training_rows_against_a_plain_loop(spark):
    rows = [
        ("a", 0, "prompt", [1, 2, 3], None), ("a", 1, "response", [4, 5], [-0.1, -0.2]), ("a", 2, "tool", [6, 7, 8], None), ("a", 3, "response", [9], [-0.3]),
        ("b", 0, "prompt", [1], None), ("b", 1, "response", [2], None), ("b", 2, "tool", [3], None),
        ("c", 0, "prompt", [1, 2], None),
        ("d", 0, "prompt", [1], None), ("d", 1, "tool", [5, 5], None), ("d", 2, "response", [2, 3], [-1.0, -2.0]), ("d", 3, "tool", [7], None),
    ]
    ep = [("a", 4, "finished", 1.0), ("b", 2, "max_step_limit", 0.0), ("d", 0, None, 0.5)]
    turns = spark.createDataFrame(rows, TURNS)
    episodes = spark.createDataFrame(ep, "run_id string, num_turns int, exit_reason string, reward double")
    got = by(tj.to_training_rows(turns, episodes, 2, 4, mask_abnormal=True, pad_id=99), "run_id")
    a = got["a"]
    assert a["prompt_ids"] == [1, 2] and a["response_ids"] == [4, 5, 6, 7] and a["response_mask"] == [1, 1, 0, 0]
    assert a["response_logprobs"] == [-0.1, -0.2, 0.0, 0.0] and a["traj_masked"] == 0 and a["num_turns"] == 4
    b = got["b"]
    assert b["response_mask"] == [0, 0] and b["traj_masked"] == 1 and b["response_logprobs"] is None
    c = got["c"]
    assert c["response_ids"] == [99] * 4 and c["response_mask"] == [0] * 4 and c["traj_exit_reason"] == "no_response" and c["num_turns"] == 0
    d = got["d"]
    # tool tokens before the first logprob add none
    assert d["response_ids"] == [5, 5, 2, 3] and d["response_logprobs"] == [-1.0, -2.0, 0.0] and d["traj_exit_reason"] == "unknown"
    for r in got.values():
        assert len(r["response_mask"]) == len(r["response_ids"])


def test_token_limits_extras_and_preemption(spark):
    rows = [("a", 0, "prompt", [1] * 3, None), ("a", 1, "response", [1] * 3, None), ("a", 2, "tool", [1] * 5, None), ("a", 3, "response", [1], None)]
    got = by(tj.flag_token_limit(spark.createDataFrame(rows, TURNS), 6), "turn")
    assert [(got[i]["over_before"], got[i]["over_after"]) for i in range(4)] == [(False, False), (False, True), (False, False), (True, True)]
    rows = [("a", 0, {}, None, None), ("a", 1, {"k": "1"}, 5, 2), ("a", 2, {"k": "2"}, None, None), ("b", 0, {}, None, 3), ("b", 1, {}, 4, 4)]
    t = spark.createDataFrame(rows, "run_id string, turn int, extra map<string,string>, max_global_steps int, num_preempted int")
    extra = by(tj.merge_extra(t), "run_id")
    assert extra["a"]["extra"] == {"k": "1"} and extra["a"]["max_global_steps"] == 5 and extra["b"]["max_global_steps"] == 4
    pre = by(tj.sum_preempted(t), "run_id")
    assert pre["a"]["num_preempted"] == 1 and pre["b"]["num_preempted"] == 7


def test_api_messages_take_the_last_call(spark):
    schema = "run_id string, turn int, role string, content string, tool_calls array<struct<id:string,name:string,arguments:string>>"
    rows = [("a", 0, "assistant", "x", [("1", "search", "{}")]), ("a", 1, "tool", "r", None), ("a", 2, "assistant", "y", []), ("a", 3, "tool", "s", None), ("a", 4, "user", "u", None)]
    got = by(tj.normalize_api_messages(spark.createDataFrame(rows, schema)), "turn")
    assert (got[1]["tool_call_id"], got[1]["name"]) == ("1", "search")
    assert got[3]["tool_call_id"] is None and got[2]["tool_calls"] is None and got[4]["tool_call_id"] is None


def _call(body):
    return f"<tool_call>{body}</tool_call>"


def test_extract_answer(spark):
    cases = {
        "plain": ([(_call('{"name":"finish","arguments":{"answer":"Paris"}}'), None)], "Paris"),
        "number": ([(_call('{"arguments":{"answer":7}}'), None)], "7"),
        "boolean": ([(_call('{"arguments":{"answer":true}}'), None)], "True"),
        "null": ([(_call('{"arguments":{"answer":null}}'), None)], "None"),
        "list": ([(_call('{"arguments":{"answer":[1,2]}}'), None)], "[1, 2]"),
        "parameters": ([(_call('{"arguments":{},"parameters":{"answer":"p"}}'), None)], "p"),
        "encoded": ([(_call('{"arguments":"{\\"answer\\":\\"e\\"}"}'), None)], "e"),
        "bad": ([(_call("{x"), "Observation:\nshown\n")], "Observation:\nshown"),
        "xml": ([("<tool_call><function=finish></tool_call>", "  seen ")], "seen"),
        "empty": ([("none", " ")], None),
        "earlier": ([(_call('{"arguments":{"answer":"first"}}'), None), ("none", "")], "first"),
        "later": ([(_call('{"arguments":{"answer":"first"}}'), None), ("none", "obs")], "obs"),
    }
    rows = [(k, i + 1, 0, r, o, "finished") for k, (steps, _) in cases.items() for i, (r, o) in enumerate(steps)]
    rows.append(("open", 1, 0, _call('{"arguments":{"answer":"x"}}'), None, "completed"))
    df = spark.createDataFrame(rows, "run_id string, step_idx int, ord int, response string, observation string, exit_reason string")
    got = by(tj.extract_answer(df), "run_id")
    assert {k: got[k]["answer"] for k in cases} == {k: w for k, (_, w) in cases.items()}
    assert got["open"]["answer"] is None
    assert by(tj.extract_answer(df, strict=False), "run_id")["bad"]["answer"] == "shown"


def test_messages_and_roles(spark):
    rows = [("a", 1, "r1", "o1", None, "completed"), ("a", 2, "r2", None, "bad", "format_error"), ("a", 3, "", None, None, "token_limit")]
    df = spark.createDataFrame(rows, "run_id string, step_idx int, response string, observation string, error_text string, exit_reason string")
    m = sorted((r.msg_idx, r.role, r.content) for r in tj.build_messages(df).collect())
    assert m == [(2, "assistant", "r1"), (3, "tool", "o1"), (4, "assistant", "r2"), (5, "tool", "bad")]
    roles = spark.createDataFrame([("user",), ("tool",), ("assistant",), (None,)], "role string")
    assert tj.check_roles(roles).count() == 2
