"""Aggregate reports over rewards, results and episodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.operators.ordered import Order, number_rows


def row_score(token_scores: Column) -> Column:
    """Score of one rollout: the sum over its token positions."""
    return F.aggregate(token_scores, F.lit(0.0), lambda acc, x: acc + x)


def mean_score(rows: DataFrame, token_scores: str = "rm_scores") -> DataFrame:
    """Mean rollout score over all rows."""
    return rows.agg(F.avg(row_score(F.col(token_scores))).alias("mean_score"), F.count("*").alias("n_rows"))


def avg_at_n(results: DataFrame, task_col: str = "task", value: str = "score") -> DataFrame:
    """Mean over tasks of each task's mean over its rollouts."""
    per_task = results.groupBy(task_col).agg(F.avg(F.col(value).cast("double")).alias("_rate"), F.count("*").alias("_n"))
    return per_task.agg(
        F.avg("_rate").alias("avg_at_n"), F.count("*").alias("n_tasks"), F.min("_n").alias("min_n"), F.max("_n").alias("max_n")
    )


def failure_class() -> Column:
    """success, wrong_answer or timed_out."""
    return (
        F.when(F.col("resolved"), "success").when(F.col("eval_completed"), "wrong_answer").otherwise("timed_out")
    )


def verify_report(results: DataFrame) -> DataFrame:
    """Counts per class and mean evaluation time over rows that have one."""
    c = failure_class()
    return results.agg(
        F.count("*").alias("total"),
        F.count_if(c == "success").alias("success"),
        F.count_if(c == "wrong_answer").alias("wrong_answer"),
        F.count_if(c == "timed_out").alias("timed_out"),
        F.avg("eval_execution_time").alias("avg_execution_time"),
        F.count("eval_execution_time").alias("n_timed"),
    )


def verify_failures(results: DataFrame, name: str = "instance_id", keep: Sequence[str] = ()) -> DataFrame:
    """Names of failed instances and the columns ``keep``, one row each (a list of them could outgrow any row)."""
    c = failure_class()
    return results.select(c.alias("failure_class"), name, *keep).where(F.col("failure_class") != "success")


def attach_results(samples: DataFrame, results: DataFrame, key: str = "run_id") -> DataFrame:
    """Pair samples with their results by run id; a sample without a result stays, with nulls."""
    return samples.join(results, key, "left")


def repeat_rollouts(samples: DataFrame, n: int) -> DataFrame:
    """Each sample ``n`` times with ``rollout_idx`` 0..n-1."""
    return samples.withColumn("rollout_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def episode_metrics(steps: DataFrame) -> DataFrame:
    """Turns, lengths, token use and seconds per run."""
    reasons = ["finished", "completed", "format_error", "timeout_error", "syntax_error", "token_limit", "terminal_not_alive", "max_step_limit", "unknown_error"]
    return steps.groupBy("run_id").agg(
        F.count("*").alias("num_turns"),
        F.sum(F.length(F.coalesce("response", F.lit("")))).alias("response_chars"),
        F.count("tool").alias("tool_calls"),
        *[F.count_if(F.col("exit_reason") == r).alias(f"n_{r}") for r in reasons],
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("generate_seconds").alias("generate_seconds"),
        F.sum("execution_time").alias("tool_seconds"),
        F.max_by("exit_reason", F.struct("step_idx", "ord")).alias("exit_reason"),
    )


def episode_totals(metrics: DataFrame, episodes: DataFrame) -> DataFrame:
    """Add the whole episode's seconds and its reward from ``episodes(run_id, execution_time, reward_score)``."""
    own = episodes.select("run_id", F.col("execution_time").alias("episode_seconds"), F.col("reward_score").alias("reward"))
    return metrics.join(own, "run_id", "left")


def turn_usage(steps: DataFrame) -> DataFrame:
    """Tokens and seconds of each turn; a closing row without a call has none."""
    return steps.select("run_id", "step_idx", "ord", "prompt_tokens", "completion_tokens", "generate_seconds", F.col("execution_time").alias("tool_seconds"))


def tool_call_counts(steps: DataFrame) -> DataFrame:
    """Calls and tool seconds per tool."""
    return steps.where(F.col("tool").isNotNull()).groupBy("tool").agg(
        F.count("*").alias("n_calls"), F.sum("execution_time").alias("tool_seconds")
    )


def limit_samples(samples: DataFrame, n: int, order: Order) -> DataFrame:
    """The first ``n`` samples by an order column; ``n <= 0`` keeps all."""
    return samples if n <= 0 else samples.orderBy(order).limit(n)


def assign_chunks(samples: DataFrame, order: Order, workers: int = 8) -> DataFrame:
    """Contiguous ceil-sized chunks: adds ``chunk`` 0..workers-1."""
    size = (samples.count() - 1) // workers + 1
    numbered = number_rows(samples, order, "_rn")
    return numbered.withColumn("chunk", F.floor((F.col("_rn") - 1) / max(size, 1)).cast("int")).drop("_rn")


def union_results(*parts: DataFrame) -> DataFrame:
    """Concatenate result sets by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
