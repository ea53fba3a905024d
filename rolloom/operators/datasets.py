"""Task-dataset builders: nested samples from raw task rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.functions import jsonv
from rolloom.functions.text import render_prompt
from rolloom.operators.ordered import Order, number_rows

# Names, templates and commands of the sample formats.
SEARCH_AGENT = "search_agent"
SWE_AGENT = "swe_agent"
DEFAULT_DATA_SOURCE = "asearcher"
QUESTION_PREFIX = "Question: "
IMAGE_TEMPLATES = {
    "swe-bench": "swe-bench/sweb.eval.x86_64.{project_name}_1776_{instance_number}:latest",
    "swe-bench-verified": "swe-bench-verified/sweb.eval.x86_64.{project_name}_1776_{instance_number}:v2",
    "swe-rebench": "swe-rebench/{project_name}_1776_{instance_number}:latest",
    "swe-bench-live": "swe-bench-live/{project_name}_1776_{instance_number}:latest",
    "r2e-gym-subset": "r2e-gym-subset/{instance_number}:latest",
}
HUB_TEMPLATES = {
    "swe-bench-verified": "swebench/sweb.eval.x86_64.{project_name}_1776_{instance_number}",
    "swe-rebench": "swerebench/sweb.eval.x86_64.{project_name}_1776_{instance_number}",
}
RESET_VERIFIED = ["cd /testbed", "git restore .", "git reset --hard", "git checkout {commit}", "git clean -fdq"]
RESET_REBENCH = [
    "git tag -d $(git tag -l) || true",
    "git reflog expire --expire=now --all || true",
    "git gc --prune=now || true",
    "git checkout {commit} || true",
    "git clean -fdq || true",
]
REBENCH_METADATA = [
    "instance_id",
    "base_commit",
    "patch",
    "problem_statement",
    "repo",
    "test_patch",
    "FAIL_TO_PASS",
    "FAIL_TO_FAIL",
    "PASS_TO_PASS",
    "PASS_TO_FAIL",
]
REBENCH_INSTALL = ["install", "log_parser", "test_cmd"]


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _chat(system: str, user: Column) -> Column:
    return F.array(_message("system", F.lit(system)), _message("user", user))


def coerce_targets(ground_truth_json: Column) -> Column:
    """Target list from ground truth given as JSON text: an object's ``target``, a list, a scalar or null."""

    def as_list(text: Column) -> Column:
        kind = jsonv.json_kind(jsonv.strict_json(text))
        empty = F.array().cast("array<string>")
        return jsonv.let(
            kind,
            lambda k: F.when(k.isNull() | (k == "null"), empty)
            .when(k == "array", F.from_json(text, "array<string>"))
            .otherwise(F.array(F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v"))),
        )

    def unwrap(v: Column) -> Column:
        inner = F.when(jsonv.member(v, "target").isNotNull(), F.to_json(jsonv.member(v, "target")))
        return F.when(jsonv.json_kind(v) == "object", F.coalesce(inner, ground_truth_json)).otherwise(ground_truth_json)

    return jsonv.let(jsonv.let(jsonv.strict_json(ground_truth_json), unwrap), as_list)


def build_search_samples(raw: DataFrame, system: str, prefix: str = QUESTION_PREFIX) -> DataFrame:
    """Search samples from ``question, ground_truth`` (JSON text) ``, data_source, split, index``.

    Every other column of the raw row is kept inside ``extra_info``; a null question is an error.
    """
    question = F.coalesce("question", F.raise_error(F.lit("a search task has no question")).cast("string"))
    truth = F.struct(F.col("_targets").alias("target"))
    overlaid = {"index", "question", "split", "tools_kwargs", "_targets"}
    kept = [F.col(c) for c in raw.columns if c not in overlaid]
    extra = F.struct(
        *kept,
        F.col("index"),
        F.col("question"),
        F.col("split"),
        F.struct(F.struct(truth.alias("ground_truth")).alias("reward")).alias("tools_kwargs"),
    )
    return raw.withColumn("_targets", coerce_targets(F.col("ground_truth"))).select(
        F.coalesce(F.nullif(F.col("data_source"), F.lit("")), F.lit(DEFAULT_DATA_SOURCE)).alias("data_source"),
        _chat(system, F.concat(F.lit(prefix.rstrip("\n")), question)).alias("prompt"),
        F.struct(truth.alias("ground_truth"), F.lit("rule").alias("style")).alias("reward_model"),
        extra.alias("extra_info"),
        F.lit(SEARCH_AGENT).alias("agent_name"),
    )


def positional_split(df: DataFrame, order: Order, n_train: int, n_test: int) -> DataFrame:
    """First ``n_train`` rows to train, the next ``n_test`` to test, with a per-split ``index`` from 0.

    Too few rows is an error, found by a count before anything is written.
    """
    total = df.count()
    if total < n_train + n_test:
        raise ValueError(f"{total} rows, but {n_train + n_test} are needed")
    rn = F.col("_rn")
    return (
        number_rows(df, order, "_rn")
        .where(rn <= n_train + n_test)
        .withColumn("split", F.when(rn <= n_train, "train").otherwise("test"))
        .withColumn("index", F.when(rn <= n_train, rn - 1).otherwise(rn - 1 - n_train))
        .drop("_rn")
    )


def instance_id(repo: Column, commit: Column) -> Column:
    """Repository and short commit as one id."""
    return F.concat_ws("__", repo, F.substring(commit, 1, 10))


def reset_script(commit: Column, flavour: str) -> Column:
    """Shell line that resets the repository; ``verified`` stops at a failure, ``rebench`` goes on."""
    commands = {"verified": RESET_VERIFIED, "rebench": RESET_REBENCH}[flavour]
    return F.replace(F.lit(" && ".join(commands)), F.lit("{commit}"), commit)


def image_name(instance: Column, dataset: str, backend: str = "registry", registry: str = "") -> Column:
    """Container image of an instance id ``project__number``.

    ``registry`` is the registry host of the deployment, put before the image path;
    ``backend='hub'`` uses the public hub names instead.
    """
    templates = HUB_TEMPLATES if backend == "hub" else IMAGE_TEMPLATES
    if dataset not in templates:
        raise ValueError(f"only support {list(templates)}, got {dataset}")
    parts = F.split(instance, "__")
    two = F.when(F.size(parts) == 2, parts).otherwise(
        F.raise_error(F.concat(F.lit("not a two-part instance id: "), instance)).cast("array<string>")
    )
    path = F.replace(F.lit(templates[dataset]), F.lit("{project_name}"), F.lower(F.get(two, F.lit(0))))
    path = F.replace(path, F.lit("{instance_number}"), F.lower(F.get(two, F.lit(1))))
    return F.concat(F.lit(registry.rstrip("/") + "/"), path) if registry else path


def _swe_sample(df: DataFrame, system: str, user_template: str, image: Column, setup: Column, reward: str, metadata: Column) -> DataFrame:
    env = F.struct(image.alias("image"), setup.alias("post_setup_cmd"))
    rew = F.struct(F.lit(reward).alias("name"), F.to_json(metadata).alias("metadata"))
    return df.select(
        _chat(system, render_prompt(F.col("problem_statement"), user_template)).alias("prompt"),
        F.lit(SWE_AGENT).alias("agent_name"),
        F.struct(F.struct(env.alias("env"), rew.alias("reward")).alias("tools_kwargs")).alias("extra_info"),
    )


def build_swe_verified(df: DataFrame, system: str, user_template: str, backend: str = "registry", registry: str = "") -> DataFrame:
    """Samples of the verified set; the whole source row is the reward metadata (JSON text)."""
    image = image_name(F.col("instance_id"), "swe-bench-verified", backend, registry)
    return _swe_sample(df, system, user_template, image, reset_script(F.col("base_commit"), "verified"), "swe_bench", F.struct("*"))


def build_swe_rebench(df: DataFrame, system: str, user_template: str, backend: str = "registry", registry: str = "") -> DataFrame:
    """Samples with thirteen metadata fields, three of them lifted out of ``install_config``."""
    metadata = F.struct(*REBENCH_METADATA, *[F.col(f"install_config.{c}").alias(c) for c in REBENCH_INSTALL])
    image = image_name(F.col("instance_id"), "swe-rebench", backend, registry)
    return _swe_sample(df, system, user_template, image, reset_script(F.col("base_commit"), "rebench"), "swe_rebench", metadata)


def build_r2e(df: DataFrame, system: str, user_template: str, setup_cmd: str, registry: str = "") -> DataFrame:
    """Samples from ``repo_name, commit_hash, problem_statement, patch, expected_output_json``."""
    df = df.withColumn("instance_id", instance_id(F.col("repo_name"), F.col("commit_hash")))
    metadata = F.struct(F.col("repo_name").alias("repo"), "instance_id", "patch", "expected_output_json")
    image = image_name(F.col("instance_id"), "r2e-gym-subset", "registry", registry)
    return _swe_sample(df, system, user_template, image, F.lit(setup_cmd), "r2e_gym", metadata)


def effective_config(samples: DataFrame, agents: Mapping[str, Mapping[str, object]]) -> DataFrame:
    """Overlay a sample's own image, setup command and reward on its agent's configuration.

    ``agents`` maps agent name to ``{"image", "post_setup_cmd", "reward": {key: text}}``; it is a
    configuration file's worth of literals. ``samples``: ``agent_name, image, post_setup_cmd,
    reward map<string,string>``. An empty merged reward becomes null.
    """
    text_map = "map<string,string>"

    def literal(reward: Mapping[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for kv in reward.items() for x in kv]).cast(text_map)

    def per_agent(field: str, wrap) -> Column:
        out = F.lit(None)
        for name, conf in agents.items():
            out = F.when(F.col("agent_name") == name, wrap(conf.get(field))).otherwise(out)
        return out

    base = F.coalesce(per_agent("reward", lambda r: literal(r or {})), F.create_map().cast(text_map))
    own = F.coalesce("reward", F.create_map().cast(text_map))
    kept = F.map_filter(F.col("_base"), lambda k, _: ~F.map_contains_key(F.col("_own"), k))
    return (
        samples.withColumns({"_base": base, "_own": own})
        .withColumns(
            {
                "image": F.coalesce("image", per_agent("image", F.lit)),
                "post_setup_cmd": F.coalesce("post_setup_cmd", per_agent("post_setup_cmd", F.lit)),
                "reward": F.map_concat(kept, "_own"),
            }
        )
        .withColumn("reward", F.when(F.size("reward") > 0, F.col("reward")))
        .drop("_base", "_own")
    )


def filter_overlong(df: DataFrame, n_tokens: str, max_len: int, mode: str = "filter", ids: str | None = None) -> DataFrame:
    """Prompts over the budget: dropped (``filter``), cut on the left (``left``) or an error (``error``)."""
    n = F.col(n_tokens)
    if mode == "filter":
        return df.where(n <= max_len)
    if mode == "left":
        cut = F.slice(ids, F.greatest(F.size(ids) - max_len, F.lit(0)) + 1, F.lit(max_len))
        return df.withColumn(ids, cut).withColumn(n_tokens, F.least(n, F.lit(max_len)))
    if mode == "error":
        return df.withColumn(n_tokens, F.when(n <= max_len, n).otherwise(F.raise_error(F.lit(f"prompt longer than {max_len} tokens")).cast("bigint")))
    raise ValueError(f"unknown truncation mode {mode!r}")
