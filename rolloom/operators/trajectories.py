"""Multi-turn trajectories: step outcomes, episode ends, messages and training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rolloom.functions import jsonv
from rolloom.functions.text import py_strip, strip_ansi
from rolloom.operators.ordered import running

# Sentences, limits and tool names that decide results.
EMPTY_OBSERVATION = "Your command ran successfully and did not produce any output."
MAX_OBSERVATION = 100_000
CLIP_NOTE = (
    "<response clipped>\n<NOTE>Observations should not exceeded {limit} characters. {elided} characters were elided. "
    "Please try a different command that produces less output or "
    "use head/tail/grep/redirect the output to a file. Do not use interactive pagers.</NOTE>"
)
FINAL_TOOLS = ["finish", "submit"]
TIMEOUT_BUDGET = 3
DUMMY_RESPONSE = 512
APPENDABLE_ROLES = ["user", "tool"]


def clean_observation(raw: Column, limit: int = MAX_OBSERVATION, strict: bool = True) -> Column:
    """Observation text shown to the model.

    ``strict`` keeps the published note, whose elided count is negative
    (limit minus length); ``strict=False`` reports the number of characters cut.
    """
    text = strip_ansi(raw)
    n = F.length(text)
    elided = F.lit(limit) - n if strict else n - F.lit(limit)
    note = F.replace(F.lit(CLIP_NOTE.replace("{limit}", str(limit))), F.lit("{elided}"), elided.cast("string"))
    return (
        F.when(py_strip(text) == "", EMPTY_OBSERVATION)
        .when(n > limit, F.concat(F.lit("Observation:\n"), F.substring(text, 1, limit), note))
        .otherwise(F.concat(F.lit("Observation:\n"), text))
    )


def classify_steps(steps: DataFrame, timeout_budget: int = TIMEOUT_BUDGET) -> DataFrame:
    """Add ``exit_reason`` and ``done``.

    Input columns: ``run_id, step_idx, over_budget BOOLEAN`` (token limit hit),
    ``parse_error BOOLEAN``, ``env_error`` (timeout, syntax, dead or null), ``tool``.
    """
    over, bad = F.coalesce("over_budget", F.lit(False)), F.coalesce("parse_error", F.lit(False))
    reason = (
        F.when(over, "token_limit")
        .when(bad, "format_error")
        .when(F.col("env_error") == "timeout", "timeout_error")
        .when(F.col("env_error") == "syntax", "syntax_error")
        .when(F.col("env_error") == "dead", "terminal_not_alive")
        .when(F.col("tool").isin(FINAL_TOOLS), "finished")
        .otherwise("completed")
    )
    named = steps.withColumn("exit_reason", reason)
    counted = running(
        named, ["run_id"], "step_idx", sums={"_timeouts": F.when(F.col("exit_reason") == "timeout_error", 1).otherwise(0)}
    )
    done = F.col("exit_reason").isin("token_limit", "terminal_not_alive", "finished") | (
        (F.col("exit_reason") == "timeout_error") & (F.col("_timeouts") > timeout_budget)
    )
    return counted.withColumn("done", done).drop("_timeouts")


def close_episodes(steps: DataFrame, max_turns: int, strict: bool = True) -> DataFrame:
    """Cut each run at its first final step and append the turn-limit row.

    Adds ``ord`` (0 for a step, 1 for the appended row). ``strict`` appends
    ``max_step_limit`` even when the last allowed step finished. Steps past the
    limit are filtered before the shuffle, so a run has at most ``max_turns`` rows here.
    """
    stop = F.col("done") | (F.col("exit_reason") == "unknown_error")
    kept = steps.where(F.col("step_idx") <= max_turns).withColumn("ord", F.lit(0))
    first = F.min(F.when(stop, F.col("step_idx"))).over(W.partitionBy("run_id"))
    kept = kept.withColumn("_stop", first).where(F.col("_stop").isNull() | (F.col("step_idx") <= F.col("_stop")))
    limit_hit = (F.col("step_idx") == max_turns) & (F.col("exit_reason") != "unknown_error")
    if not strict:
        limit_hit = limit_hit & ~F.col("done")
    clear = {"exit_reason": F.lit("max_step_limit"), "done": F.lit(False), "ord": F.lit(1)}
    keep = {"run_id", "step_idx", *clear}

    def appended(name: str, dtype) -> Column:
        value = clear.get(name, F.col(name) if name in keep else F.lit(None))
        return value.cast(dtype).alias(name)

    fields = [(f.name, f.dataType) for f in kept.drop("_stop").schema.fields]
    pair = F.when(
        limit_hit,
        F.array(F.struct(*[F.col(n) for n, _ in fields]), F.struct(*[appended(n, t) for n, t in fields])),
    ).otherwise(F.array(F.struct(*[F.col(n) for n, _ in fields])))
    return kept.select(F.explode(pair).alias("s")).select("s.*")


def build_messages(steps: DataFrame, n_prompt: int = 2) -> DataFrame:
    """Assistant and tool message per step, numbered after the ``n_prompt`` opening messages.

    A token-limit step appends nothing and is always the last of its run, so the
    number follows from the step index alone.
    """
    reply = F.coalesce(F.col("error_text"), F.col("observation"), F.lit(""))
    pair = F.array(
        F.struct(F.lit("assistant").alias("role"), F.col("response").alias("content")),
        F.struct(F.lit("tool").alias("role"), reply.alias("content")),
    )
    return (
        steps.where(F.col("exit_reason") != "token_limit")
        .select("run_id", "step_idx", F.posexplode(pair).alias("_i", "m"))
        .select("run_id", (F.lit(n_prompt) + (F.col("step_idx") - 1) * 2 + F.col("_i")).alias("msg_idx"), "m.role", "m.content")
    )


def check_roles(messages: DataFrame) -> DataFrame:
    """Messages whose role may not be appended to a running conversation."""
    return messages.where(~F.coalesce(F.col("role").isin(APPENDABLE_ROLES), F.lit(False)))


def normalize_api_messages(messages: DataFrame) -> DataFrame:
    """Keep what a chat API accepts; a tool message takes id and name of the last call.

    Input: ``run_id, turn, role, content, tool_calls array<struct<id,name,arguments>>``.
    """
    first_call = F.get("tool_calls", F.lit(0))
    call_of = F.when(F.col("role") == "assistant", F.struct(first_call["id"].alias("id"), first_call["name"].alias("name")))
    seen = running(messages, ["run_id"], "turn", lasts={"_call": call_of})
    is_tool = F.col("role") == "tool"
    keeps_calls = (F.col("role") == "assistant") & (F.size("tool_calls") > 0)
    return seen.select(
        "run_id",
        "turn",
        "role",
        "content",
        F.when(keeps_calls, F.col("tool_calls")).alias("tool_calls"),
        F.when(is_tool, F.col("_call.id")).alias("tool_call_id"),
        F.when(is_tool, F.col("_call.name")).alias("name"),
    )


# --- rollout arrays ---------------------------------------------------------


def token_offsets(turns: DataFrame) -> DataFrame:
    """Add per-turn token counts and running offsets.

    Input: ``run_id, turn, kind`` (prompt, response or tool), ``ids array<bigint>``,
    ``logprobs array<double>``. Tool tokens get a 0.0 logprob only once the run has
    any logprob; ``lp_n`` is the number of logprobs the turn contributes.
    """
    n = F.coalesce(F.size("ids"), F.lit(0))
    own = F.when(F.col("kind") == "response", F.coalesce(F.size(F.coalesce("logprobs", F.array().cast("array<double>"))), F.lit(0))).otherwise(0)
    turns = turns.withColumns(
        {
            "p_n": F.when(F.col("kind") == "prompt", n).otherwise(0),
            "r_n": F.when(F.col("kind") != "prompt", n).otherwise(0),
            "_own": own,
        }
    )
    seen = running(
        turns, ["run_id"], "turn", sums={"p_end": F.col("p_n"), "r_end": F.col("r_n"), "_seen": F.col("_own")}
    )
    padded = F.when((F.col("kind") == "tool") & (F.col("_seen") > 0), F.col("r_n")).otherwise(F.col("_own"))
    return running(seen.withColumn("lp_n", padded), ["run_id"], "turn", sums={"lp_end": F.col("lp_n")}).drop("_own", "_seen")


def flag_token_limit(turns: DataFrame, max_model_len: int) -> DataFrame:
    """Add ``over_before`` and ``over_after`` for response turns."""
    end = F.col("p_end") + F.col("r_end")
    is_response = F.col("kind") == "response"
    return token_offsets(turns).withColumns(
        {
            "over_before": is_response & (end - F.col("p_n") - F.col("r_n") >= max_model_len),
            "over_after": is_response & (end >= max_model_len),
        }
    )


def build_masks(turns: DataFrame) -> DataFrame:
    """Add per-turn ``mask`` and padded ``lp`` arrays."""
    mask = F.array_repeat(F.when(F.col("kind") == "response", 1).otherwise(0), F.col("r_n").cast("int"))
    lp = F.when(F.col("kind") == "tool", F.array_repeat(F.lit(0.0), F.col("lp_n").cast("int"))).otherwise(
        F.coalesce("logprobs", F.array().cast("array<double>"))
    )
    return token_offsets(turns).withColumns(
        {"mask": mask, "lp": F.when(F.col("kind") == "prompt", F.array().cast("array<double>")).otherwise(lp)}
    )


def _head(values: Column, end: Column, n: Column, limit: int) -> Column:
    """The part of a turn's array that lies within the first ``limit`` tokens of the run."""
    return F.slice(values, 1, F.greatest(F.lit(0), F.least(n, F.lit(limit) - (end - n))).cast("int"))


def to_training_rows(
    turns: DataFrame,
    episodes: DataFrame,
    max_prompt_length: int,
    max_response_length: int,
    mask_abnormal: bool = False,
    pad_id: int = 0,
) -> DataFrame:
    """One training row per run.

    ``episodes``: ``run_id, num_turns, exit_reason, reward``. Every turn is cut to
    what lies inside the length limits before the per-run collect, so a collected
    group never exceeds the limits, however long the run is.
    """
    t = build_masks(turns)
    empty_long, empty_int, empty_double = (F.array().cast(f"array<{k}>") for k in ("bigint", "int", "double"))
    pr = F.when(F.col("p_n") > 0, _head(F.col("ids"), F.col("p_end"), F.col("p_n"), max_prompt_length)).otherwise(empty_long)
    rs = F.when(F.col("r_n") > 0, _head(F.col("ids"), F.col("r_end"), F.col("r_n"), max_response_length)).otherwise(empty_long)
    mk = F.when(F.col("r_n") > 0, _head(F.col("mask"), F.col("r_end"), F.col("r_n"), max_response_length)).otherwise(empty_int)
    lp = F.when(F.col("lp_n") > 0, _head(F.col("lp"), F.col("lp_end"), F.col("lp_n"), max_response_length)).otherwise(empty_double)
    cut = t.select("run_id", "turn", "r_n", pr.alias("pr"), rs.alias("rs"), mk.alias("mk"), lp.alias("lp"))
    keep = (F.size("pr") > 0) | (F.size("rs") > 0) | (F.size("lp") > 0)
    part = F.when(keep, F.struct("turn", "pr", "rs", "mk", "lp"))
    runs = cut.groupBy("run_id").agg(F.array_sort(F.collect_list(part)).alias("_parts"), F.sum("r_n").alias("_total_r"))

    def whole(field: str) -> Column:
        return F.flatten(F.transform("_parts", lambda p: p[field]))

    joined = runs.join(episodes, "run_id", "left")
    reason = F.when(F.coalesce("num_turns", F.lit(0)) > 0, F.col("exit_reason")).otherwise("unknown")
    no_response = F.col("_total_r") == 0
    n_dummy = min(DUMMY_RESPONSE, max_response_length)
    masked = F.lit(mask_abnormal) & (reason != "finished")
    mask = F.when(masked, F.transform(whole("mk"), lambda _: F.lit(0))).otherwise(whole("mk"))
    logprobs = F.when(F.size(whole("lp")) > 0, whole("lp"))
    return joined.select(
        "run_id",
        whole("pr").alias("prompt_ids"),
        F.when(no_response, F.array_repeat(F.lit(pad_id).cast("bigint"), n_dummy)).otherwise(whole("rs")).alias("response_ids"),
        F.when(no_response, F.array_repeat(F.lit(0), n_dummy)).otherwise(mask).alias("response_mask"),
        F.when(no_response, F.array_repeat(F.lit(0.0), n_dummy)).otherwise(logprobs).alias("response_logprobs"),
        F.when(no_response, 0.0).otherwise(F.col("reward")).alias("reward_score"),
        F.when(no_response, 0).otherwise(F.coalesce("num_turns", F.lit(0))).alias("num_turns"),
        F.when(no_response, 1).otherwise(masked.cast("int")).alias("traj_masked"),
        F.when(no_response, "no_response").otherwise(reason).alias("traj_exit_reason"),
    )


def cut_routed_experts(rows: DataFrame, column: str = "routed_experts") -> DataFrame:
    """Cut routed-expert ids to the final prompt plus response length."""
    return rows.withColumn(column, F.slice(column, 1, F.size("prompt_ids") + F.size("response_ids")))


def failed_rows(prompts: DataFrame, max_prompt_length: int, max_response_length: int, pad_id: int = 0) -> DataFrame:
    """Placeholder rows of runs whose loop failed: ``run_id, prompt_ids``."""
    n = min(DUMMY_RESPONSE, max_response_length)
    return prompts.select(
        "run_id",
        F.slice("prompt_ids", 1, max_prompt_length).alias("prompt_ids"),
        F.array_repeat(F.lit(pad_id).cast("bigint"), n).alias("response_ids"),
        F.array_repeat(F.lit(0), n).alias("response_mask"),
        F.array_repeat(F.lit(0.0), n).alias("response_logprobs"),
        F.lit(0.0).alias("reward_score"),
        F.lit(0).alias("num_turns"),
        F.lit(1).alias("traj_masked"),
        F.lit("agent_loop_failed").alias("traj_exit_reason"),
    )


def merge_extra(turns: DataFrame) -> DataFrame:
    """Extra fields of the first turn that has any; the newest ``max_global_steps`` wins."""
    has = F.size("extra") > 0
    return turns.groupBy("run_id").agg(
        F.min_by("extra", F.when(has, F.col("turn"))).alias("extra"),
        F.max_by("max_global_steps", F.when(F.col("max_global_steps").isNotNull(), F.col("turn"))).alias("max_global_steps"),
    )


def sum_preempted(turns: DataFrame, column: str = "num_preempted") -> DataFrame:
    """Preemptions per run: a missing first report counts -1, later ones 0."""
    first_missing = F.min_by(F.col(column).isNull(), F.col("turn"))
    total = F.sum(F.coalesce(column, F.lit(0)))
    return turns.groupBy("run_id").agg((total - F.when(first_missing, 1).otherwise(0)).alias(column))


# --- answers ----------------------------------------------------------------


def _truthy_text(text: Column, kind: Column) -> Column:
    """The text of a JSON member unless Python would treat its value as false."""
    falsy = (
        (kind == "null")
        | ((kind == "string") & (text == ""))
        | (kind.isin("object", "array") & text.isin("{}", "[]"))
        | ((kind == "bool") & (text == "false"))
        | (kind.isin("int", "float") & F.coalesce(text.try_cast("double") == 0, F.lit(False)))
    )
    return F.when(kind.isNotNull() & ~falsy, text)


def _called_answer(response: Column) -> Column:
    """Text of the answer argument of the first call in a response."""

    def member(raw: Column, v: Column, key: str) -> Column:
        pair = F.struct(jsonv.member_text(raw, key).alias("t"), jsonv.json_kind(jsonv.member(v, key)).alias("k"))
        return jsonv.let(pair, lambda p: _truthy_text(p["t"], p["k"]))

    def answer(args: Column) -> Column:
        def shown(v: Column) -> Column:
            kind = F.when(jsonv.json_kind(v) == "object", jsonv.json_kind(jsonv.member(v, "answer")))
            text = F.coalesce(jsonv.member_text(args, "answer"), F.lit("null"))
            return jsonv.let(kind, lambda k: F.when(k.isNotNull(), jsonv.python_str(k, text)))

        return jsonv.let(jsonv.strict_json(args), shown)

    def from_call(raw: Column) -> Column:
        def pick(v: Column) -> Column:
            args = F.coalesce(member(raw, v, "arguments"), member(raw, v, "parameters"))
            return F.when(jsonv.json_kind(v) == "object", jsonv.let(args, answer))

        return jsonv.let(jsonv.strict_json(raw), pick)

    return jsonv.let(py_strip(F.regexp_extract(response, r"(?s)<tool_call>(.*?)</tool_call>", 1)), from_call)


def extract_answer(steps: DataFrame, strict: bool = True, order: Sequence[str] = ("step_idx", "ord")) -> DataFrame:
    """Answer of the last finished step that yields one, per run.

    The call's JSON comes first, then the stripped observation. ``strict`` leaves
    the ``Observation:`` prefix on that fallback. Runs without an answer keep a row.
    """
    seen = py_strip(F.coalesce("observation", F.lit("")))
    if not strict:
        seen = py_strip(F.regexp_replace(seen, r"\AObservation:\n", ""))
    candidate = F.when(
        F.col("exit_reason") == "finished", F.coalesce(_called_answer(F.col("response")), F.when(seen != "", seen))
    )
    tagged = steps.select("run_id", candidate.alias("_c"), F.struct(*order).alias("_o"))
    at = F.when(F.col("_c").isNotNull(), F.col("_o"))
    return tagged.groupBy("run_id").agg(F.max_by("_c", at).alias("answer"))
