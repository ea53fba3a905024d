import io
import json
import random

import pytest
from pyspark.sql import functions as F

from rolloom.operators import datasets as ds
from rolloom.sources import files, sinks
from rolloom.sources.store import open_store
from tests.conftest import by


def test_coerce_targets(spark):
    cases = [('{"target":"x"}', ["x"]), ('{"target":["a","b"]}', ["a", "b"]), ('{"target":null}', []), ('["p"]', ["p"]), ("5", ["5"]), ('"s"', ["s"]), (None, []), ("null", [])]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, g string")
    got = by(df.select("i", ds.coerce_targets(F.col("g")).alias("t")), "i")
    assert [got[i]["t"] for i in range(len(cases))] == [w for _, w in cases]


def test_search_samples_and_split(spark, tmp_path):
    raw = spark.createDataFrame([(i, f"q{i}", '"a"', "" if i else "nq", i * 2) for i in range(6)], "id int, question string, ground_truth string, data_source string, extra int")
    split = ds.positional_split(raw, "id", 3, 2)
    out = ds.build_search_samples(split, "sys", "Question: \n")
    rows = {r.extra_info.id: r for r in out.collect()}
    assert sorted((k, r.extra_info.split, r.extra_info["index"]) for k, r in rows.items()) == [(0, "train", 0), (1, "train", 1), (2, "train", 2), (3, "test", 0), (4, "test", 1)]
    r = rows[1]
    assert [(m.role, m.content) for m in r.prompt] == [("system", "sys"), ("user", "Question: q1")]
    assert r.data_source == "asearcher" and rows[0].data_source == "nq" and r.agent_name == "search_agent" and r.extra_info.extra == 2
    assert r.extra_info.tools_kwargs.reward.ground_truth.target == ["a"] and r.reward_model.style == "rule"
    with pytest.raises(ValueError):
        ds.positional_split(raw, "id", 5, 2)
    bad = raw.withColumn("question", F.lit(None).cast("string")).withColumns({"split": F.lit("train"), "index": F.lit(0)})
    with pytest.raises(Exception, match="no question"):
        ds.build_search_samples(bad, "sys").collect()
    sinks.write_samples(out.withColumn("split", F.col("extra_info.split")), str(tmp_path / "s"))
    assert files.read_samples(spark, str(tmp_path / "s")).where("split = 'test'").count() == 2


def test_images_ids_and_scripts(spark):
    df = spark.createDataFrame([("Org__Repo-1", "0123456789abcdef")], "i string, c string")
    r = df.select(
        ds.image_name(F.col("i"), "swe-bench-verified", registry="host/").alias("a"), ds.image_name(F.col("i"), "swe-rebench", "hub").alias("b"), ds.image_name(F.col("i"), "r2e-gym-subset").alias("c"),
        ds.instance_id(F.lit("repo"), F.col("c")).alias("d"), ds.reset_script(F.col("c"), "verified").alias("e"), ds.reset_script(F.col("c"), "rebench").alias("f"),
    ).first()
    assert r.a == "host/swe-bench-verified/sweb.eval.x86_64.org_1776_repo-1:v2"
    assert r.b == "swerebench/sweb.eval.x86_64.org_1776_repo-1" and r.c == "r2e-gym-subset/repo-1:latest" and r.d == "repo__0123456789"
    assert r.e.endswith("git checkout 0123456789abcdef && git clean -fdq") and r.f.count("|| true") == 5
    with pytest.raises(ValueError):
        ds.image_name(F.col("i"), "other")
    with pytest.raises(Exception, match="two-part"):
        df.select(ds.image_name(F.lit("a__b__c"), "swe-bench").alias("x")).collect()


def test_prompt_is_filled_literally(spark):
    row = (("P__1", "c", "has $1 and \\ and {x}"),)
    df = spark.createDataFrame(row, "instance_id string, base_commit string, problem_statement string")
    s = ds.build_swe_verified(df, "sys", "<{problem_statement}>").first()
    assert s.prompt[1].content == "<has $1 and \\ and {x}>"
    assert json.loads(s.extra_info.tools_kwargs.reward.metadata) == {"instance_id": "P__1", "base_commit": "c", "problem_statement": "has $1 and \\ and {x}"}


def test_effective_config_and_overlong(spark):
    df = spark.createDataFrame([("a", "own", None, {"x": "1"}), ("a", None, "cmd", None), ("b", None, None, None)], "agent_name string, image string, post_setup_cmd string, reward map<string,string>")
    agents = {"a": {"image": "base", "reward": {"x": "0", "name": "n"}}, "b": {"post_setup_cmd": "p"}}
    got = sorted(ds.effective_config(df, agents).collect(), key=str)
    rows = {(r.agent_name, r.image): (r.post_setup_cmd, r.reward) for r in got}
    assert rows[("a", "own")] == (None, {"name": "n", "x": "1"}) and rows[("a", "base")] == ("cmd", {"x": "0", "name": "n"}) and rows[("b", None)] == ("p", None)
    t = spark.createDataFrame([(1, [1, 2, 3], 3), (2, [1], 1)], "i int, ids array<int>, n bigint")
    assert [r.i for r in ds.filter_overlong(t, "n", 2).collect()] == [2]
    assert by(ds.filter_overlong(t, "n", 2, "left", "ids"), "i")[1]["ids"] == [2, 3]
    with pytest.raises(Exception, match="longer than"):
        ds.filter_overlong(t, "n", 2, "error").collect()


def test_task_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n [{"q": "1"},\n {"q": "2"}]')
    (tmp_path / "b.json").write_text('{"q": "1"}\n{"q": "2"}\n{"q": "3"}\n')
    assert files.read_tasks(spark, str(tmp_path / "a.json"), "q string").count() == 2
    assert files.read_tasks(spark, str(tmp_path / "b.json"), "q string").count() == 3


def _elements(raw, range_bytes, chunk):
    """Both passes over the ranges of a file, without Spark."""
    from rolloom.sources import json_array as ja

    q = d = 0
    out = []
    for start in range(0, max(len(raw), 1), range_bytes):
        stop = min(start + range_bytes, len(raw))
        stream = io.BytesIO(raw)
        out += [e for e in ja._elements(stream, start, stop, len(raw), q, d, chunk) if e.strip()]
        quotes, outside, inside = ja._counted(stream, start, stop, chunk)
        d += inside if q else outside
        q = (q + quotes) % 2
    return [json.loads(e) for e in out]


def test_array_elements_for_any_cut():
    rng = random.Random(3)
    rows = [{"q": "".join(rng.choice('\\"[]{},é\n x') for _ in range(rng.randint(0, 12))), "n": [rng.randint(0, 9), {"a": [1, "]"]}]} for _ in range(25)]
    rows += [[], {}, "a,b", None, 3.5, {"q": "\\" * 9}, {"q": "\\" * 40 + '"'}, [[1, 2], [3]]]
    for indent in (None, 2):
        raw = (" \n" + json.dumps(rows, indent=indent, ensure_ascii=False) + "\n").encode()
        for range_bytes in (1, 2, 3, 7, 31, 500, 10**6):
            for chunk in (1, 5, 64, 10**6) if range_bytes > 2 else (64,):
                assert _elements(raw, range_bytes, chunk) == rows
    assert _elements(b" [ ] ", 2, 3) == [] == _elements(b"", 2, 3) == _elements(b'{"a": [1, 2]}', 3, 3)
    with pytest.raises(ValueError, match="inside an element"):
        _elements(b'[{"a": 1}, {"b"', 4, 4)


def test_an_array_is_read_by_several_tasks(spark, tmp_path):
    rows = [{"i": i, "q": f'{i}, "x" [' + "y" * (i % 50), "deep": {"l": [f"{i}]", "}"]}} for i in range(3000)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    schema = "i bigint, q string, deep struct<l array<string>>"
    got = files.read_tasks(spark, str(tmp_path / "a.json"), schema, range_bytes=8192)
    assert got.rdd.getNumPartitions() > 8
    tasks = got.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(tasks) > 8 and max(t["count"] for t in tasks) < 1500
    single = spark.read.schema(schema).json(str(tmp_path / "a.json"), multiLine=True)
    assert sorted(got.collect()) == sorted(single.collect()) and got.schema == single.schema
    (tmp_path / "one.json").write_text(json.dumps([{"i": 1, "q": "z" * 300_000}, {"i": 2, "q": ""}]))
    assert sorted((r.i, len(r.q)) for r in files.read_tasks(spark, str(tmp_path / "one.json"), schema, range_bytes=4096).collect()) == [(1, 300_000), (2, 0)]
    (tmp_path / "none.json").write_text(" [] ")
    assert files.read_tasks(spark, str(tmp_path / "none.json"), schema).collect() == []
    (tmp_path / "empty.json").write_text("")
    assert files.read_tasks(spark, str(tmp_path / "empty.json"), schema).collect() == []


def test_paths_without_a_scheme_are_refused_in_tasks():
    with pytest.raises(ValueError, match="names no file system"):
        open_store("/tmp/x")


def test_passages_skip_broken_files(spark, tmp_path):
    spark.range(5).selectExpr("cast(id as string) id").write.parquet(str(tmp_path / "p"))
    (tmp_path / "p" / "bad.parquet").write_bytes(b"not parquet")
    assert files.read_passages(spark, str(tmp_path / "p"), "id string").count() == 5


def test_trajectory_files_and_run_scan(spark, tmp_path):
    for run, steps in {"r1": 2, "r2": 1}.items():
        (tmp_path / run / "sub").mkdir(parents=True)
        body = {"trajectory": [{"step_idx": i + 1, "response": "x", "done": i + 1 == steps, "exit_reason": "finished"} for i in range(steps)], "execution_time": 1.0, "messages": [], "metrics": {"m": 1.0}}
        (tmp_path / run / "interaction_result.json").write_text(json.dumps(body, indent=2))
        (tmp_path / run / "sub" / "f.txt").write_text("abc")
    (tmp_path / "empty").mkdir()
    (tmp_path / "loose.txt").write_text("x")
    t = sorted((r.run_id, r.ord, r.step_idx, r.exit_reason) for r in files.read_trajectories(spark, str(tmp_path)).collect())
    assert t == [("r1", 0, 1, "finished"), ("r1", 1, 2, "finished"), ("r2", 0, 1, "finished")]
    s = sorted((r.run_id, r.path or "", r.size or 0) for r in files.scan_runs(spark, str(tmp_path)).collect())
    assert [x[:2] for x in s] == [("empty", ""), ("r1", "interaction_result.json"), ("r1", "sub/f.txt"), ("r2", "interaction_result.json"), ("r2", "sub/f.txt")]
    assert ("r1", "sub/f.txt", 3) in s


def test_rollouts_and_empty_index(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1, 2], [0.5])], "run_id string, response_ids array<bigint>, response_logprobs array<double>")
    sinks.write_rollouts(rows, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).first().response_ids == [1, 2]
    assert not sinks.write_index(rows, rows.limit(0), str(tmp_path / "i"))
    assert not (tmp_path / "i").exists()


class _Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        part = super().read(n)
        self.taken += len(part)
        return part


def test_small_ranges_read_little_beyond_them_and_share_tasks(spark, tmp_path):
    from rolloom.sources import json_array as ja

    rows = [{"i": i, "q": "é," * 40} for i in range(40_000)]
    raw = json.dumps(rows).encode()
    stream = _Counting(raw)
    found, q, d, step = [], 0, 0, 1 << 14
    for start in range(0, len(raw), step):
        stop = min(start + step, len(raw))
        found += ja._elements(stream, start, stop, len(raw), q, d, ja.CHUNK_BYTES)
        quotes, outside, inside = ja._counted(io.BytesIO(raw), start, stop, ja.CHUNK_BYTES)
        d += inside if q else outside
        q = (q + quotes) % 2
    assert len(found) == len(rows) and stream.taken < 2 * len(raw)
    (tmp_path / "a.json").write_bytes(raw)
    (tmp_path / "b.json").write_bytes(raw)
    got = ja.array_elements(spark, str(tmp_path), step)
    assert len(raw) // step > 2 * ja.LEAST_TASKS and got.rdd.getNumPartitions() == ja.LEAST_TASKS
    assert [tuple(r) for r in got.groupBy("path").agg(F.count("*"), F.count_distinct("text")).select(F.count("*"), F.sum("count(1)"), F.sum("count(DISTINCT text)")).collect()] == [(2, 80_000, 80_000)]
