"""Reward scoring: search answers, test logs and their routing by reward name."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rolloom.functions.jsonv import let
from rolloom.functions.text import END_MARKER, START_MARKER, exact_match, py_words, strip_ansi, test_section

# Status words, parser names and scores.
STATUS_WORDS = ["FAILED", "PASSED", "SKIPPED", "ERROR", "XFAIL"]
PARSERS = ["parse_log_pytest", "parse_log_pytest_v2", "pytest"]
SUCCESS_STATUSES = ["PASSED", "XFAIL"]
NO_REWARD_SCORE = -100.0

_CONTROL = "".join(chr(i) for i in range(1, 32))


def score_search(answers: DataFrame, samples: DataFrame) -> DataFrame:
    """``answers(run_id, answer)`` and ``samples(run_id, targets)`` -> 1.0 or 0.0 per run."""
    j = answers.join(samples, "run_id", "left")
    hit = F.col("answer").isNotNull() & (F.size("targets") > 0) & exact_match(F.col("answer"), F.col("targets"))
    return j.select("run_id", "answer", "targets", F.when(hit, 1.0).otherwise(0.0).alias("score"))


# --- test logs --------------------------------------------------------------


def log_lines(outputs: DataFrame, text: str = "output") -> DataFrame:
    """Lines of the test section; a log without both markers yields no lines.

    Input ``run_id, output``; output ``run_id, pos, line``.
    """
    section = test_section(strip_ansi(F.col(text)))
    return outputs.select("run_id", F.posexplode(F.split(section, "\n", -1)).alias("pos", "line"))


def section_lines(lines: DataFrame) -> DataFrame:
    """Test-section lines of logs stored one line per row (``run_id, pos, line``).

    The few marker lines locate each section, so no log is ever assembled: the first start
    marker, any end marker, and the next marker after the start. One pass over the lines
    finds them, a second one cuts.
    """
    n_starts = F.size(F.split("line", START_MARKER)) - 1
    marks = (
        lines.where(F.col("line").contains(START_MARKER) | F.col("line").contains(END_MARKER))
        .withColumn("line", strip_ansi(F.col("line")))
        .select(
            "run_id",
            "pos",
            (n_starts > 0).alias("is_start"),
            F.col("line").contains(END_MARKER).alias("is_end"),
            # a second marker on the line of the first one ends the section at once
            ((n_starts > 1) | F.split_part("line", F.lit(START_MARKER), F.lit(2)).contains(END_MARKER)).alias("closes_itself"),
        )
    )
    own = W.partitionBy("run_id")
    marks = marks.withColumns({"s": F.min(F.when(F.col("is_start"), F.col("pos"))).over(own), "_any_end": F.max("is_end").over(own)})
    later = (F.col("pos") > F.col("s")) | ((F.col("pos") == F.col("s")) & F.col("closes_itself"))
    bounds = marks.where(F.col("s").isNotNull() & F.col("_any_end")).groupBy("run_id").agg(F.min("s").alias("s"), F.min(F.when(later, F.col("pos"))).alias("e"))
    after = F.when(F.col("pos") == F.col("s"), F.split_part("line", F.lit(START_MARKER), F.lit(2))).otherwise(F.col("line"))
    head = F.split_part(F.split_part("line", F.lit(END_MARKER), F.lit(1)), F.lit(START_MARKER), F.lit(1))
    return (
        lines.join(bounds, "run_id")
        .where((F.col("pos") >= F.col("s")) & (F.col("e").isNull() | (F.col("pos") <= F.col("e"))))
        .withColumn("line", strip_ansi(F.col("line")))
        .withColumn("line", after)
        .select("run_id", "pos", F.when(F.col("pos") == F.col("e"), head).otherwise(F.col("line")).alias("line"))
    )


def _any_of(test: Callable[[str], Column]) -> Column:
    out = test(STATUS_WORDS[0])
    for word in STATUS_WORDS[1:]:
        out = out | test(word)
    return out


def _line_status(line: Column, v2: Column) -> Column:
    """``struct<test,status>`` of a line, or null.

    Each step is bound once, so that no sub-expression is repeated.
    """

    def report(words: Column, status_first: Column) -> Column:
        first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
        test, status = F.when(status_first, second).otherwise(first), F.when(status_first, first).otherwise(second)
        return F.when(F.size(words) >= 2, F.struct(test.alias("test"), status.alias("status")))

    def tidy(bare: Column) -> Column:
        starts = _any_of(bare.startswith)
        spaced = F.when(bare.startswith("FAILED"), F.replace(bare, F.lit(" - "), F.lit(" "))).otherwise(bare)
        return F.when(starts, let(py_words(spaced), lambda w: report(w, F.lit(True)))).when(
            v2 & _any_of(bare.endswith), let(py_words(bare), lambda w: report(w, F.lit(False)))
        )

    def clean(text: Column) -> Column:
        uncoloured = F.when(text.contains("["), F.regexp_replace(text, r"\[(\d+)m", "")).otherwise(text)
        return let(F.when(v2, F.translate(uncoloured, _CONTROL, "")).otherwise(text), tidy)

    return let(line, clean)


def parse_statuses(lines: DataFrame, parser: str | Column = "parse_log_pytest") -> DataFrame:
    """``run_id, test, status`` with the last line of a test winning.

    ``parser`` is a name or a column of names (one per line's run); an unknown name is
    an error. The final aggregate combines on the map side, so a huge log costs no huge
    group.
    """
    parser = F.lower(F.trim(F.lit(parser) if isinstance(parser, str) else parser))
    known = F.coalesce(parser.isin(PARSERS), F.lit(False))
    fail = F.raise_error(F.concat(F.lit("unknown log parser "), F.coalesce(parser, F.lit("null")))).cast("boolean")
    v2 = F.when(known, parser == "parse_log_pytest_v2").otherwise(fail)
    # a generator drops lines without a status, so that each line is parsed once
    one = F.filter(F.array(_line_status(F.col("line"), v2)), lambda f: f.isNotNull())
    found = lines.select("run_id", "pos", F.inline(one))
    return found.groupBy("run_id", "test").agg(F.max_by("status", "pos").alias("status"))


def coarse_status(status: Column) -> Column:
    """pass, skip or fail; an expected failure counts as fail."""
    low = F.lower(status)
    return F.when(low.contains("pass"), "pass").when(low.contains("skip"), "skip").otherwise("fail")


def score_swe(statuses: DataFrame, tests: DataFrame, found: DataFrame) -> DataFrame:
    """Resolution per run from parsed statuses and required tests.

    ``tests(run_id, test, list_name, fail_only)`` holds FAIL_TO_PASS and PASS_TO_PASS
    entries as rows; ``found(run_id, found_eval_status)`` has every run once. A
    required test must succeed; absent counts as failure, except in fail-only
    repositories, where only a FAILED status fails.
    """
    j = tests.join(statuses, ["run_id", "test"], "left")
    passed = F.when(F.coalesce("fail_only", F.lit(False)), ~F.coalesce(F.col("status") == "FAILED", F.lit(False))).otherwise(
        F.coalesce(F.col("status").isin(SUCCESS_STATUSES), F.lit(False))
    )
    f2p = F.col("list_name") == "FAIL_TO_PASS"
    graded = j.withColumn("_ok", passed).groupBy("run_id").agg(
        F.count_if(f2p & F.col("_ok")).alias("f2p_success"),
        F.count_if(f2p & ~F.col("_ok")).alias("f2p_failure"),
        F.count_if(~f2p & F.col("_ok")).alias("p2p_success"),
        F.count_if(~f2p & ~F.col("_ok")).alias("p2p_failure"),
    )
    counts = ["f2p_success", "f2p_failure", "p2p_success", "p2p_failure"]
    out = found.join(graded, "run_id", "left").fillna(0, counts)
    seen = F.coalesce("found_eval_status", F.lit(False))
    clean = (F.col("f2p_failure") == 0) & (F.col("p2p_failure") == 0)
    return out.select(
        "run_id", seen.alias("found_eval_status"), *[F.when(seen, F.col(c)).otherwise(0).alias(c) for c in counts],
        (seen & clean).alias("resolved"),
    )


def score_swe_live(statuses: DataFrame, tests: DataFrame, found: DataFrame) -> DataFrame:
    """Live rule: no listed test fails and at least one FAIL_TO_PASS test passes.

    Absent tests do not count against a run.
    """
    coarse = statuses.select("run_id", "test", coarse_status(F.col("status")).alias("c"))
    j = tests.dropDuplicates(["run_id", "test", "list_name"]).join(coarse, ["run_id", "test"], "left")
    f2p = F.col("list_name") == "FAIL_TO_PASS"
    graded = j.groupBy("run_id").agg(
        F.count_if(f2p & (F.col("c") == "pass")).alias("f2p_success"),
        F.count_if(f2p & (F.col("c") == "fail")).alias("f2p_failure"),
        F.count_if(~f2p & (F.col("c") == "pass")).alias("p2p_success"),
        F.count_if(~f2p & (F.col("c") == "fail")).alias("p2p_failure"),
    )
    counts = ["f2p_success", "f2p_failure", "p2p_success", "p2p_failure"]
    out = found.join(graded, "run_id", "left").fillna(0, counts)
    seen = F.coalesce("found_eval_status", F.lit(False))
    ok = (F.col("p2p_failure") == 0) & (F.col("f2p_failure") == 0) & (F.col("f2p_success") > 0)
    return out.select(
        "run_id", seen.alias("found_eval_status"), *[F.when(seen, F.col(c)).otherwise(0).alias(c) for c in counts],
        (seen & ok).alias("resolved"),
    )


def _short_names(statuses: DataFrame) -> DataFrame:
    """Drop colours from names and cut them at the first ``" - "``; of colliding names the one sorting last wins."""
    plain = statuses.withColumn("test", strip_ansi(F.col("test")))
    short = F.split_part("test", F.lit(" - "), F.lit(1))
    return plain.groupBy("run_id", short.alias("_short")).agg(F.max_by("status", "test").alias("status")).withColumnRenamed("_short", "test")


def score_r2e(parsed: DataFrame, expected: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Compare parsed with expected statuses (both ``run_id, test, status``) per run.

    Resolved when both sides have equally many names and every non-empty parsed
    name is expected with the same status. With ``runs(run_id)`` every run has a row, also
    one without any name on either side.
    """
    p = _short_names(parsed).withColumnRenamed("status", "p_status")
    e = _short_names(expected).withColumnRenamed("status", "e_status")
    both = p.join(e, ["run_id", "test"], "full_outer")
    wrong = F.col("p_status").isNotNull() & (F.col("test") != "") & ~F.coalesce(F.col("p_status") == F.col("e_status"), F.lit(False))
    per_run = both.groupBy("run_id").agg(
        F.count("p_status").alias("n_parsed"), F.count("e_status").alias("n_expected"), F.count_if(wrong).alias("n_wrong")
    )
    if runs is not None:
        per_run = runs.select("run_id").distinct().join(per_run, "run_id", "left").fillna(0, ["n_parsed", "n_expected", "n_wrong"])
    return per_run.withColumn("found_eval_status", F.col("n_parsed") > 0).withColumn(
        "resolved", (F.col("n_parsed") == F.col("n_expected")) & (F.col("n_wrong") == 0)
    )


# --- routing ----------------------------------------------------------------

_REWARDS: dict[str, Callable[[], Column]] = {}


def register_reward(name: str, build: Callable[[], Column]) -> None:
    """Register a score expression under a reward name; it may use any column of the rows."""
    if name in _REWARDS and _REWARDS[name] is not build:
        raise ValueError(f"reward {name!r} is already registered")
    _REWARDS[name] = build


def resolved_score() -> Column:
    """1.0 when the run's tests resolved."""
    return F.coalesce(F.col("resolved"), F.lit(False)).cast("double")


def answer_score() -> Column:
    """1.0 when the answer matches a target."""
    hit = F.col("answer").isNotNull() & (F.size("targets") > 0) & exact_match(F.col("answer"), F.col("targets"))
    return F.when(hit, 1.0).otherwise(0.0)


for _name in ("swe_bench", "swe_rebench", "swe_bench_live", "r2e_gym"):
    register_reward(_name, resolved_score)
register_reward("search", answer_score)


def score(rows: DataFrame, name: str = "reward_name") -> DataFrame:
    """Add ``score`` in one pass: no reward name scores -100, an unknown name is an error."""
    chain = F.when(F.col(name).isNull(), F.lit(NO_REWARD_SCORE))
    for reward, build in _REWARDS.items():
        chain = chain.when(F.col(name) == reward, build())
    return rows.withColumn("score", chain.otherwise(F.raise_error(F.concat(F.lit("unknown reward "), F.col(name))).cast("double")))


Tables = Mapping[str, DataFrame]
Grader = Callable[[DataFrame, Tables], DataFrame]
_GRADERS: dict[str, Grader] = {}


def register_grader(name: str, grade_runs: Grader) -> None:
    """Register how runs with a reward name are graded.

    ``grade_runs`` gets its own runs, ``run_id`` and their other columns, and the tables that
    :func:`grade` was given by name; it returns ``run_id, score``.
    """
    if name in _GRADERS and _GRADERS[name] is not grade_runs:
        raise ValueError(f"grader {name!r} is already registered")
    _GRADERS[name] = grade_runs


def own_rows(tables: Tables, name: str, runs: DataFrame) -> DataFrame:
    """Rows of a named table that belong to the runs."""
    if name not in tables:
        raise ValueError(f"grading needs a table {name!r}, given: {sorted(tables)}")
    return tables[name].join(runs.select("run_id"), "run_id", "left_semi")


def _by_tests(rule: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> Grader:
    """Grade by ``parsed`` statuses, ``required`` tests and ``found`` sections."""

    def graded(runs: DataFrame, tables: Tables) -> DataFrame:
        resolved = rule(*[own_rows(tables, t, runs) for t in ("parsed", "required", "found")])
        return resolved.select("run_id", F.col("resolved").cast("double").alias("score"))

    return graded


def _by_matching(runs: DataFrame, tables: Tables) -> DataFrame:
    """Grade by ``statuses`` against ``expected``; a run without any is resolved."""
    resolved = score_r2e(own_rows(tables, "statuses", runs), own_rows(tables, "expected", runs), runs)
    return resolved.select("run_id", F.col("resolved").cast("double").alias("score"))


def _by_answer(runs: DataFrame, tables: Tables) -> DataFrame:
    """Grade by ``answers`` against ``targets``."""
    return score_search(own_rows(tables, "answers", runs), own_rows(tables, "targets", runs))


for _name, _grader in {
    "swe_bench": _by_tests(score_swe), "swe_rebench": _by_tests(score_swe), "swe_bench_live": _by_tests(score_swe_live),
    "r2e_gym": _by_matching, "search": _by_answer,
}.items():
    register_grader(_name, _grader)


def grade(runs: DataFrame, tables: Tables, name: str = "reward_name") -> DataFrame:
    """``run_id``, reward name and ``score`` of every run: each registered grader gets its own runs and the tables.

    A run without a reward name scores -100, one that its grader returns no row for 0.0; an
    unknown name is an error.
    """
    used = [r[0] for r in runs.where(F.col(name).isin(*_GRADERS)).select(name).distinct().collect()]  # at most the registered names
    scored = [_GRADERS[reward](runs.where(F.col(name) == reward), tables).select("run_id", F.col("score").cast("double").alias("score")) for reward in sorted(used)]
    every = reduce(DataFrame.union, scored, runs.select("run_id", F.lit(0.0).alias("score")).limit(0))
    unknown = F.raise_error(F.concat(F.lit("unknown reward "), F.col(name))).cast("double")
    score_ = F.when(F.col(name).isNull(), F.lit(NO_REWARD_SCORE)).when(F.col(name).isin(*_GRADERS), F.coalesce("score", F.lit(0.0))).otherwise(unknown)
    return runs.select("run_id", name).join(every, "run_id", "left").select("run_id", name, score_.alias("score"))
