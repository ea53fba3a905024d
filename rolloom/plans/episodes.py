"""Trajectory and training-row queries over ``events`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rolloom.functions.text import completion_tokens
from rolloom.operators import reports, trajectories
from rolloom.operators.ordered import number_within, ranges
from rolloom.plans.registry import as_long, query, table
from rolloom.session import work_path
from rolloom.sources import sinks

MAX_TURNS = 20


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as the steps of a run, in time order."""
    e = table(spark, sf_dir, "events")
    e = ranges(e, ["ts", "event_id"], "_range")
    e = number_within(e, ["user_id"], ["ts", "event_id"], F.col("_range"), "step_idx")
    kind = F.col("event_type")
    return e.select(
        F.col("user_id").alias("run_id"),
        "step_idx",
        "event_id",
        F.lit(False).alias("over_budget"),
        (kind == "signup").alias("parse_error"),
        F.when(kind == "error", "timeout").alias("env_error"),
        F.when(kind == "purchase", "finish").when(kind.isin("click", "view"), "search").alias("tool"),
        F.concat(F.lit("do "), kind, F.lit(" "), F.col("event_id").cast("string")).alias("response"),
        F.col("props").alias("raw_observation"),
        F.col("value").alias("execution_time"),
        F.length("props").alias("prompt_tokens"),
        F.col("event_id").alias("completion_tokens"),
        (F.col("value") / 2).alias("generate_seconds"),
    )


_STEPS_SQL = """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step_idx FROM events),
c AS (SELECT user_id AS run_id, step_idx, event_id, event_type, value, props,
   CASE event_type WHEN 'signup' THEN 'format_error' WHEN 'error' THEN 'timeout_error' WHEN 'purchase' THEN 'finished' ELSE 'completed' END AS exit_reason,
   CASE event_type WHEN 'purchase' THEN 'finish' WHEN 'click' THEN 'search' WHEN 'view' THEN 'search' END AS tool,
   sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY step_idx) AS timeouts FROM n),
steps AS (SELECT *, exit_reason = 'finished' OR (exit_reason = 'timeout_error' AND timeouts > 3) AS done FROM c)
"""
_CLOSE_SQL = (
    _STEPS_SQL
    + """,
capped AS (SELECT * FROM steps WHERE step_idx <= 20),
kept AS (SELECT k.* FROM (SELECT *, min(CASE WHEN done THEN step_idx END) OVER (PARTITION BY run_id) AS stop FROM capped) k WHERE stop IS NULL OR step_idx <= stop),
closed AS (SELECT run_id, step_idx, 0 AS ord, event_id, exit_reason, done, tool, value, props, event_type FROM kept
   UNION ALL SELECT run_id, step_idx, 1, NULL, 'max_step_limit', false, NULL, NULL, NULL, NULL FROM kept WHERE step_idx = 20)
"""
)


@query("step_outcomes", _STEPS_SQL + "SELECT run_id, step_idx, event_id, exit_reason, done FROM steps")
def step_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectories.classify_steps(event_steps(spark, sf_dir)).select("run_id", "step_idx", "event_id", "exit_reason", "done")


def closed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectories.close_episodes(trajectories.classify_steps(event_steps(spark, sf_dir)), MAX_TURNS)


@query("episode_close", _CLOSE_SQL + "SELECT run_id, step_idx, ord, event_id, exit_reason, done FROM closed")
def episode_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closed_steps(spark, sf_dir).select("run_id", "step_idx", "ord", "event_id", "exit_reason", "done")


@query(
    "episode_metrics",
    _CLOSE_SQL
    + """
SELECT run_id, count(*) AS num_turns, CAST(sum(coalesce(length('do ' || event_type || ' ' || event_id), 0)) AS BIGINT) AS response_chars, count(tool) AS tool_calls,
  """
    + ", ".join(
        f"count(*) FILTER (exit_reason = '{r}') AS n_{r}"
        for r in "finished completed format_error timeout_error syntax_error token_limit terminal_not_alive max_step_limit unknown_error".split()
    )
    + """,
  CAST(sum(length(props)) AS BIGINT) AS prompt_tokens, CAST(sum(event_id) AS BIGINT) AS completion_tokens,
  round(sum(value / 2), 4) AS generate_seconds, round(sum(value), 4) AS tool_seconds, arg_max(exit_reason, step_idx * 2 + ord) AS exit_reason
FROM closed GROUP BY run_id""",
)
def episode_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = reports.episode_metrics(closed_steps(spark, sf_dir))
    return m.withColumns({c: F.round(c, 4) for c in ("generate_seconds", "tool_seconds")})


@query(
    "tool_call_counts",
    _CLOSE_SQL + "SELECT tool, count(*) AS n_calls, round(sum(value), 4) AS tool_seconds FROM closed WHERE tool IS NOT NULL GROUP BY tool",
)
def tool_call_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.tool_call_counts(closed_steps(spark, sf_dir)).withColumn("tool_seconds", F.round("tool_seconds", 4))


@query(
    "message_log",
    _CLOSE_SQL
    + """
SELECT run_id, 2 + (step_idx - 1) * 2 + i AS msg_idx, CASE i WHEN 0 THEN 'assistant' ELSE 'tool' END AS role,
  CASE i WHEN 0 THEN 'do ' || event_type || ' ' || event_id
     ELSE CASE WHEN exit_reason IN ('completed', 'finished') THEN 'Observation:' || chr(10) || props ELSE 'failed: ' || exit_reason END END AS content
FROM closed, (SELECT unnest([0, 1]) AS i) WHERE ord = 0""",
)
def message_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ran = F.col("exit_reason").isin("completed", "finished")
    steps = closed_steps(spark, sf_dir).where("ord = 0").withColumns(
        {
            "observation": F.when(ran, trajectories.clean_observation(F.col("raw_observation"))),
            "error_text": F.when(~ran, F.concat(F.lit("failed: "), F.col("exit_reason"))),
        }
    )
    return trajectories.build_messages(steps)


@query(
    "observations",
    """
SELECT doc_id, CASE WHEN regexp_matches(t, '^\\s*$') THEN 'Your command ran successfully and did not produce any output.'
  WHEN length(t) > 2000 THEN 'Observation:' || chr(10) || substr(t, 1, 2000) || '<response clipped>' || chr(10)
    || '<NOTE>Observations should not exceeded 2000 characters. ' || (2000 - length(t)) || ' characters were elided. Please try a different command that produces less output or use head/tail/grep/redirect the output to a file. Do not use interactive pagers.</NOTE>'
  ELSE 'Observation:' || chr(10) || t END AS observation
FROM (SELECT doc_id, regexp_replace(chr(27) || '[1m' || text || chr(13), chr(27) || '\\[[0-9;]*m|\\r', '', 'g') AS t FROM documents)""",
)
def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    coloured = F.concat(F.lit("\x1b[1m"), F.col("text"), F.lit("\r"))
    return table(spark, sf_dir, "documents").select("doc_id", trajectories.clean_observation(coloured, limit=2000).alias("observation"))


@query(
    "role_violations",
    "SELECT conv_id AS run_id, turn, role FROM conversations WHERE role NOT IN ('user', 'tool')",
)
def role_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), "turn", "role")
    return trajectories.check_roles(messages)


def api_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as chat-API messages: user turns become tool replies."""
    c = table(spark, sf_dir, "conversations")
    call = F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.when(F.pmod("turn", F.lit(3)) == 0, "finish").otherwise("search").alias("name"), F.lit("{}").alias("arguments")
    )
    calls = F.when((F.col("role") == "assistant") & (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4)) != 0), F.array(call))
    return c.select(
        F.col("conv_id").alias("run_id"), "turn", F.when(F.col("role") == "user", "tool").otherwise(F.col("role")).alias("role"),
        F.col("text").alias("content"), calls.alias("tool_calls"),
    )


@query(
    "api_transcript",
    """
WITH m AS (SELECT *, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS la FROM conversations)
SELECT conv_id AS run_id, turn, CASE role WHEN 'user' THEN 'tool' ELSE role END AS role, text AS content,
  CASE WHEN role = 'assistant' AND (conv_id + turn) % 4 <> 0 THEN 1 ELSE 0 END AS n_calls,
  CASE WHEN role = 'user' AND la IS NOT NULL AND (conv_id + la) % 4 <> 0 THEN conv_id || '-' || la END AS tool_call_id,
  CASE WHEN role = 'user' AND la IS NOT NULL AND (conv_id + la) % 4 <> 0 THEN CASE WHEN la % 3 = 0 THEN 'finish' ELSE 'search' END END AS name,
  greatest(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')), 1) AS completion_tokens
FROM m""",
)
def api_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = trajectories.normalize_api_messages(api_messages(spark, sf_dir))
    return n.select(
        "run_id", "turn", "role", "content", F.coalesce(F.size("tool_calls"), F.lit(0)).alias("n_calls"), "tool_call_id", "name",
        completion_tokens(F.col("content")).cast("bigint").alias("completion_tokens"),
    )


# --- training rows ----------------------------------------------------------


def token_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code points of each whole turn as token ids; turns before the first reply are the prompt."""
    c = table(spark, sf_dir, "conversations")
    first = c.where("role = 'assistant'").groupBy("conv_id").agg(F.min("turn").alias("_first"))
    j = c.join(first, "conv_id", "left")
    kind = (
        F.when(F.col("_first").isNull() | (F.col("turn") < F.col("_first")), "prompt").when(F.col("role") == "assistant", "response").otherwise("tool")
    )
    ids = F.transform(F.filter(F.split("text", ""), lambda ch: ch != ""), lambda ch: F.ascii(ch).cast("bigint"))
    reply = (F.col("role") == "assistant") & (F.pmod("conv_id", F.lit(2)) == 0)
    logprobs = F.when(reply, F.transform(ids, lambda _, i: -i.cast("double") / 100))
    return j.select(F.col("conv_id").alias("run_id"), "turn", kind.alias("kind"), ids.alias("ids"), logprobs.alias("logprobs"))


def token_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.groupBy(F.col("conv_id").alias("run_id")).agg(
        F.count_if(F.col("role") == "assistant").cast("int").alias("num_turns"),
        F.when(F.pmod(F.first("conv_id"), F.lit(3)) == 0, "max_step_limit").otherwise("finished").alias("exit_reason"),
        F.lit(0.5).alias("reward"),
    )


_TURNS_SQL = """
WITH k AS (SELECT c.*, min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS first FROM conversations c),
t AS (SELECT conv_id AS run_id, turn, role, text, length(text) AS n,
  CASE WHEN first IS NULL OR turn < first THEN 'prompt' WHEN role = 'assistant' THEN 'response' ELSE 'tool' END AS kind,
  list_transform(string_split(text, ''), lambda ch: unicode(ch)) AS ids FROM k)
"""

_ROWS_SQL = (
    _TURNS_SQL
    + """,
runs AS (SELECT run_id,
   flatten(list(ids ORDER BY turn) FILTER (kind = 'prompt')) AS p, flatten(list(ids ORDER BY turn) FILTER (kind <> 'prompt')) AS r,
   flatten(list(list_transform(ids, lambda x: CASE WHEN kind = 'response' THEN 1 ELSE 0 END) ORDER BY turn) FILTER (kind <> 'prompt')) AS m,
   flatten(list(list_transform(ids, lambda x, i: CASE WHEN kind = 'response' THEN -(i - 1) / 100.0 ELSE 0.0 END) ORDER BY turn) FILTER (kind <> 'prompt')) AS lp,
   count(*) FILTER (role = 'assistant') AS a FROM t GROUP BY run_id),
cut AS (SELECT *, coalesce(p[1:400], []) AS p2, r[1:1500] AS r2, CASE WHEN run_id % 3 = 0 THEN list_transform(m[1:1500], lambda x: 0) ELSE m[1:1500] END AS m2, lp[1:1500] AS lp2 FROM runs),
dummy AS (SELECT *, a = 0 AS none FROM cut)
SELECT run_id, len(p2) AS n_prompt, CAST(coalesce(list_sum(list_transform(p2, lambda x, i: x * i)), 0) AS BIGINT) AS prompt_sum,
  CASE WHEN none THEN 512 ELSE len(r2) END AS n_response,
  CAST(CASE WHEN none THEN 0 ELSE list_sum(list_transform(r2, lambda x, i: x * i)) END AS BIGINT) AS response_sum,
  CAST(CASE WHEN none THEN 0 ELSE list_sum(list_transform(m2, lambda x, i: x * i)) END AS BIGINT) AS mask_sum,
  CASE WHEN none THEN 0.0 WHEN run_id % 2 = 0 THEN round(list_sum(list_transform(lp2, lambda x, i: x * i)), 3) END AS logprob_sum,
  CASE WHEN none THEN 512 WHEN run_id % 2 = 0 THEN len(lp2) END AS n_logprobs,
  CASE WHEN none THEN 0e0 ELSE 5e-1 END AS reward_score, a AS num_turns,
  CASE WHEN none OR run_id % 3 = 0 THEN 1 ELSE 0 END AS traj_masked,
  CASE WHEN none THEN 'no_response' WHEN run_id % 3 = 0 THEN 'max_step_limit' ELSE 'finished' END AS traj_exit_reason
FROM dummy"""
)


@query("training_rows", _ROWS_SQL)
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_rows(trajectories.to_training_rows(token_turns(spark, sf_dir), token_episodes(spark, sf_dir), 400, 1500, mask_abnormal=True))


def _flat_rows(rows: DataFrame) -> DataFrame:
    """Sizes and position-weighted sums of the arrays of training rows."""

    def weighted(c: str, zero) -> Column:
        return F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), zero, lambda acc, x: acc + x)

    zero = F.lit(0).cast("bigint")
    flat = rows.select(
        "run_id",
        F.size("prompt_ids").alias("n_prompt"), weighted("prompt_ids", zero).alias("prompt_sum"),
        F.size("response_ids").alias("n_response"), weighted("response_ids", zero).alias("response_sum"),
        F.aggregate(F.transform("response_mask", lambda x, i: x * (i + 1)), zero, lambda acc, x: acc + x).alias("mask_sum"),
        F.round(weighted("response_logprobs", F.lit(0.0)), 3).alias("logprob_sum"),
        F.when(F.col("response_logprobs").isNotNull(), F.size("response_logprobs")).alias("n_logprobs"),
        "reward_score", "num_turns", "traj_masked", "traj_exit_reason",
    )
    return as_long(flat, "n_prompt", "n_response", "n_logprobs", "num_turns")


@query(
    "token_limits",
    _TURNS_SQL
    + """
SELECT run_id, turn, kind, CAST(before + n AS BIGINT) AS n_tokens, kind = 'response' AND before >= 1000 AS over_before, kind = 'response' AND before + n >= 1000 AS over_after
FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY run_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)""",
)
def token_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = trajectories.flag_token_limit(token_turns(spark, sf_dir), 1000)
    return flagged.select("run_id", "turn", "kind", (F.col("p_end") + F.col("r_end")).alias("n_tokens"), "over_before", "over_after")


@query(
    "turn_extras",
    """
WITH t AS (SELECT conv_id AS run_id, turn, CASE WHEN turn % 3 = 1 THEN NULL ELSE turn * 10 END AS p, CASE WHEN turn % 2 = 1 THEN turn END AS g, role FROM conversations)
SELECT run_id, arg_min(role, turn) FILTER (turn > 0) AS first_role, arg_max(g, turn) FILTER (g IS NOT NULL) AS max_global_steps,
  CAST(sum(coalesce(p, 0)) - CASE WHEN arg_min(coalesce(p, -7), turn) = -7 THEN 1 ELSE 0 END AS BIGINT) AS num_preempted
FROM t GROUP BY run_id""",
)
def turn_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    t = t.select(
        F.col("conv_id").alias("run_id"), "turn",
        F.when(F.pmod("turn", F.lit(3)) != 1, F.col("turn") * 10).alias("num_preempted"),
        F.when(F.pmod("turn", F.lit(2)) == 1, F.col("turn")).alias("max_global_steps"),
        F.when(F.col("turn") > 0, F.create_map(F.lit("role"), F.col("role"))).otherwise(F.create_map().cast("map<string,string>")).alias("extra"),
    )
    extras = trajectories.merge_extra(t).select("run_id", F.col("extra")["role"].alias("first_role"), "max_global_steps")
    return extras.join(trajectories.sum_preempted(t), "run_id")


@query(
    "failed_runs",
    """SELECT conv_id AS run_id, least(count(*), 4) AS n_prompt, 100 AS n_response, 700 AS pad_sum, 0.0 AS reward_score, 1 AS traj_masked, 'agent_loop_failed' AS traj_exit_reason
FROM conversations GROUP BY conv_id""",
)
def failed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a run whose loop failed; its turn numbers stand for the prompt, cut before they are collected."""
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    first = table(spark, sf_dir, "conversations").select("conv_id", "turn").withColumn("place", place).where("place <= 4")
    prompts = first.groupBy(F.col("conv_id").alias("run_id")).agg(F.array_sort(F.collect_list("turn")).alias("prompt_ids"))
    rows = trajectories.failed_rows(prompts, 4, 100, pad_id=7)
    total = F.aggregate("response_ids", F.lit(0).cast("bigint"), lambda a, x: a + x)
    flat = rows.select("run_id", F.size("prompt_ids").alias("n_prompt"), F.size("response_ids").alias("n_response"), total.alias("pad_sum"), "reward_score", "traj_masked", "traj_exit_reason")
    return as_long(flat, "n_prompt", "n_response", "traj_masked")


@query(
    "routed_experts",
    """SELECT run_id, least(n, 40) AS n_kept, least(n, 40) * (least(n, 40) + 1) // 2 AS expert_sum FROM (
  SELECT conv_id AS run_id, count(*) + count(*) FILTER (role = 'assistant') AS n FROM conversations GROUP BY conv_id)""",
)
def routed_experts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty expert ids per run, cut to its prompt (all turns) and response (assistant turns)."""
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("run_id")).agg(F.count("*").alias("p"), F.count_if(F.col("role") == "assistant").alias("r"))
    # no more than the forty experts can be kept: longer arrays need not be built
    ids = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(1).cast("bigint"), F.least(F.col(n), F.lit(40)))).otherwise(F.array().cast("array<bigint>"))
    c = c.select("run_id", ids("p").alias("prompt_ids"), ids("r").alias("response_ids"))
    cut = trajectories.cut_routed_experts(c.withColumn("routed_experts", F.sequence(F.lit(1), F.lit(40))))
    total = F.aggregate("routed_experts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return as_long(cut.select("run_id", F.size("routed_experts").alias("n_kept"), total.alias("expert_sum")), "n_kept")


@query("rollout_files", _ROWS_SQL)
def rollout_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows written as rollouts and read back."""
    rows = trajectories.to_training_rows(token_turns(spark, sf_dir), token_episodes(spark, sf_dir), 400, 1500, mask_abnormal=True)
    path = work_path(spark, "rollouts")
    sinks.write_rollouts(rows, path)
    return _flat_rows(spark.read.parquet(path))


@query(
    "episode_totals",
    _CLOSE_SQL
    + """, w AS (SELECT user_id AS run_id, round(sum(value), 4) AS episode_seconds, CAST(max(event_id) % 2 AS DOUBLE) AS reward FROM events GROUP BY user_id)
SELECT run_id, count(*) AS num_turns, any_value(episode_seconds) AS episode_seconds, any_value(reward) AS reward FROM closed JOIN w USING (run_id) GROUP BY run_id""",
)
def episode_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each run with the seconds of all its events and a reward."""
    whole = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id")).agg(
        F.round(F.sum("value"), 4).alias("execution_time"), F.pmod(F.max("event_id"), F.lit(2)).cast("double").alias("reward_score")
    )
    metrics = reports.episode_metrics(closed_steps(spark, sf_dir)).select("run_id", "num_turns")
    return reports.episode_totals(metrics, whole)


@query(
    "turn_usage",
    _CLOSE_SQL + "SELECT run_id, step_idx, ord, CAST(length(props) AS BIGINT) AS prompt_tokens, event_id AS completion_tokens, value / 2 AS generate_seconds, value AS tool_seconds FROM closed",
)
def turn_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_long(reports.turn_usage(closed_steps(spark, sf_dir)), "ord", "step_idx", "prompt_tokens", "completion_tokens")
