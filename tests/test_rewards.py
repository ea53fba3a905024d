import re
import string

import pytest
from pyspark.sql import functions as F

from rolloom.functions import text as tx
from rolloom.operators import reports, rewards
from tests.conftest import by


def _normal(s):
    s = re.sub(r"\b(a|an|the)\b", " ", s.lower())
    return " ".join("".join(c for c in s if c not in string.punctuation).split())


TEXTS = ["The  Cat!", "an a the", "a-b The.end", "éa à the", "x y\tz", "Anna theme a", "ΑΒΓ the Δ", "", "it's (a) test_a a_b"]


def test_normalize_answer_equals_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in df.select("t", tx.normalize_answer(F.col("t")).alias("n")).collect():
        assert r.n == _normal(r.t), r.t


def test_search_scores(spark):
    a = spark.createDataFrame([("a", "The Paris."), ("b", None), ("c", "x"), ("d", "x"), ("e", "")], "run_id string, answer string")
    s = spark.createDataFrame([("a", ["Rome", "paris"]), ("b", ["x"]), ("c", []), ("d", None), ("e", ["the"])], "run_id string, targets array<string>")
    got = by(rewards.score_search(a, s), "run_id")
    assert {k: v["score"] for k, v in got.items()} == {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.0, "e": 1.0}


S, E = tx.START_MARKER, tx.END_MARKER


def _python_section(log):
    return log.split(S)[1].split(E)[0] if S in log and E in log else None


LOGS = {
    "plain": f"x\n+ : '{S}'\nPASSED a\nFAILED b - why\n+ : '{E}'\nPASSED late",
    "no_end": f"{S}\nPASSED a",
    "no_start": f"PASSED a\n{E}",
    "twice": f"{S}\nPASSED a\n{S}\nPASSED b\n{E}",
    "end_first": f"{E}\n{S}\nPASSED a\nPASSED c",
    "one_line": f"pre {S} PASSED x {E} post",
    "last_wins": f"{S}\nPASSED a\nFAILED a - no\nXFAIL z\nERROR\nSKIPPED [1] t.py\n{E}",
    "ansi": f"\x1b[32m{S}\r\n\x1b[31mFAILED b\x1b[0m\r\n{E}",
}


def _python_statuses(section):
    out = {}
    for line in (section or "").split("\n"):
        if line.startswith(tuple(rewards.STATUS_WORDS)):
            line = line.replace(" - ", " ") if line.startswith("FAILED") else line
            w = line.split()
            if len(w) > 1:
                out[w[1]] = w[0]
    return out


def test_sections_by_text_and_by_line_agree(spark):
    df = spark.createDataFrame(list(LOGS.items()), "run_id string, output string")
    by_text = rewards.log_lines(df)
    stored = df.select("run_id", F.posexplode(F.split("output", "\n", -1)).alias("pos", "line"))
    by_line = rewards.section_lines(stored)
    for lines in (by_text, by_line):
        got = {}
        for r in lines.collect():
            got.setdefault(r.run_id, []).append((r.pos, r.line))
        for name, log in LOGS.items():
            want = _python_section(re.sub(r"\x1b\[[0-9;]*m|\r", "", log))
            mine = "\n".join(x[1] for x in sorted(got[name])) if name in got else None
            assert mine == want, name
        st = {}
        for r in rewards.parse_statuses(lines).collect():
            st.setdefault(r.run_id, {})[r.test] = r.status
        for name, log in LOGS.items():
            assert st.get(name, {}) == _python_statuses(_python_section(re.sub(r"\x1b\[[0-9;]*m|\r", "", log))), name


def test_newer_format_and_unknown_parser(spark):
    rows = [("a", 0, "tests/x.py::t PASSED[32m"), ("a", 1, "PASSED\tb c"), ("a", 2, "[31mFAILED d - x"), ("a", 3, "see FAILED here"), ("a", 4, "one")]
    df = spark.createDataFrame(rows, "run_id string, pos int, line string")
    got = {r.test: r.status for r in rewards.parse_statuses(df, "parse_log_pytest_v2").collect()}
    # a tab is dropped, not turned into a space, so "PASSEDb" is the first word
    assert got == {"tests/x.py::t": "PASSED", "c": "PASSEDb", "d": "FAILED"}
    with pytest.raises(Exception, match="unknown log parser"):
        rewards.parse_statuses(df, "parse_other").collect()


def test_swe_live_and_r2e_rules(spark):
    st = spark.createDataFrame(
        [("a", "t0", "PASSED"), ("a", "t1", "XFAIL"), ("b", "t0", "PASSED"), ("c", "t0", "FAILED"), ("d", "t0", "SKIPPED"), ("f", "t0", "PASSED"), ("f", "t1", "XFAIL")], "run_id string, test string, status string"
    )
    lists = [("t0", "FAIL_TO_PASS"), ("t1", "PASS_TO_PASS")]
    tests = spark.createDataFrame([(r, t, name, r == "d") for r in "abcd" for t, name in lists], "run_id string, test string, list_name string, fail_only boolean")
    found = spark.createDataFrame([(r, r != "e") for r in "abcde"], "run_id string, found_eval_status boolean")
    swe = {k: v["resolved"] for k, v in by(rewards.score_swe(st, tests, found), "run_id").items()}
    assert swe == {"a": True, "b": False, "c": False, "d": True, "e": False}
    live = {k: v["resolved"] for k, v in by(rewards.score_swe_live(st, tests, found), "run_id").items()}
    # an expected failure counts as fail; an absent test does not count
    assert live == {"a": False, "b": True, "c": False, "d": False, "e": False}
    exp = spark.createDataFrame([("a", "t0 - x", "PASSED"), ("a", "t1", "XFAIL"), ("b", "t0", "FAILED"), ("c", "t0", "FAILED"), ("c", "t9", "FAILED")], "run_id string, test string, status string")
    r2e = {k: v["resolved"] for k, v in by(rewards.score_r2e(st, exp), "run_id").items()}
    assert r2e["a"] and not r2e["b"] and not r2e["c"] and not r2e["d"]
    shape = "run_id string, test string, status string"
    coloured = spark.createDataFrame([("x", "\x1b[32mt1\x1b[0m", "PASSED")], shape)
    plain = spark.createDataFrame([("x", "t1 - y", "PASSED")], shape)
    runs = spark.createDataFrame([("x",), ("none",)], "run_id string")
    both = by(rewards.score_r2e(coloured, plain, runs), "run_id")
    assert both["x"]["resolved"] and both["none"]["n_parsed"] == 0 and not both["none"]["found_eval_status"]


def test_routing(spark):
    rows = [("a", "search", "x", ["x"], None), ("b", "swe_bench", None, None, True), ("c", None, None, None, None), ("d", "r2e_gym", None, None, None)]
    df = spark.createDataFrame(rows, "run_id string, reward_name string, answer string, targets array<string>, resolved boolean")
    assert {r.run_id: r.score for r in rewards.score(df).collect()} == {"a": 1.0, "b": 1.0, "c": -100.0, "d": 0.0}
    with pytest.raises(Exception, match="unknown reward"):
        rewards.score(df.withColumn("reward_name", F.lit("other"))).collect()
    with pytest.raises(ValueError):
        rewards.register_reward("search", lambda: F.lit(0.0))


def test_reports(spark):
    r = spark.createDataFrame([("a", True, True, 2.0), ("b", False, True, None), ("c", False, False, 4.0)], "instance_id string, resolved boolean, eval_completed boolean, eval_execution_time double")
    rep = reports.verify_report(r).first().asDict()
    assert rep == {"total": 3, "success": 1, "wrong_answer": 1, "timed_out": 1, "avg_execution_time": 3.0, "n_timed": 2}
    assert sorted(map(tuple, reports.verify_failures(r).collect())) == [("timed_out", "c"), ("wrong_answer", "b")]
    assert reports.verify_report(r.limit(0)).first()["avg_execution_time"] is None
    ch = by(reports.assign_chunks(spark.range(10), "id", 8), "id")
    assert [ch[i]["chunk"] for i in range(10)] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert reports.limit_samples(spark.range(10), 0, "id").count() == 10


def test_a_new_name_is_graded_through_its_grader(spark):
    runs = spark.createDataFrame([(1, "search", 3), (2, "length", 5), (3, None, 1), (4, "length", 0), (5, "search", 1)], "run_id long, reward_name string, n int")
    tables = {
        "answers": spark.createDataFrame([(1, "The Cat"), (5, "dog")], "run_id long, answer string"),
        "targets": spark.createDataFrame([(1, ["cat"]), (5, ["cat"])], "run_id long, targets array<string>"),
    }
    calls = []

    def by_length(own, given):
        calls.append(sorted(given))
        return own.where("n > 0").select("run_id", (F.col("n") / 10).alias("score"))

    with pytest.raises(Exception, match="unknown reward length"):
        rewards.grade(runs, tables).collect()
    rewards.register_grader("length", by_length)
    try:
        rewards.register_grader("length", by_length)
        with pytest.raises(ValueError, match="already registered"):
            rewards.register_grader("length", lambda own, given: own)
        got = {r.run_id: r.score for r in rewards.grade(runs, tables).collect()}
    finally:
        rewards._GRADERS.pop("length")
    assert got == {1: 1.0, 2: 0.5, 3: rewards.NO_REWARD_SCORE, 4: 0.0, 5: 0.0} and calls == [["answers", "targets"]]
    with pytest.raises(ValueError, match="needs a table 'parsed'"):
        rewards.grade(runs.withColumn("reward_name", F.lit("swe_bench")), tables)
    expected = {"statuses": spark.createDataFrame([(1, "a.t", "PASSED")], "run_id long, test string, status string"), "expected": spark.createDataFrame([(1, "a.t", "PASSED"), (2, "b.t", "PASSED")], "run_id long, test string, status string")}
    r2e = {r.run_id: r.score for r in rewards.grade(runs.withColumn("reward_name", F.lit("r2e_gym")), expected).collect()}
    assert r2e[1] == 1.0 and r2e[2] == 0.0
