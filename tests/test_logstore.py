import pathlib
import re

import pytest
from pyspark.sql import functions as F

from rolloom.operators import logstore, monitor


def _lines(spark, logs):
    rows = [(run, src, i + 1, line) for (run, src), text in logs.items() for i, line in enumerate(text.split("\n")[:-1])]
    return spark.createDataFrame(rows, "run_id string, source string, pos bigint, line string")


def _folder(path):
    return pathlib.Path(path.removeprefix("file:"))


def _spoil(path, but):
    """Make every stored file outside the named folders unreadable; returns how many."""
    files = [f for f in _folder(path).rglob("*.parquet") if f.parent.name not in but]
    for f in files:
        f.write_bytes(b"nothing")
    for f in _folder(path).rglob("*.crc"):
        f.unlink()
    return len(files)


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    texts = {("a", "run.log"): "".join(f"line {i} é日本\n" for i in range(400)), ("b", "run.log"): "x\n\n" + "y" * 300 + "\n", ("b", "verify.log"): "é\n"}
    path = str(tmp_path_factory.mktemp("store") / "logs")
    lines = _lines(spark, texts)
    logstore.write_lines(lines, path, block_lines=8, parts=16, segment_blocks=3)
    return lines, path


def _all(df):
    return sorted(map(tuple, df.collect()))


def test_block_offsets(spark, logs):
    lines, path = logs
    want = {}
    for r in monitor.byte_offsets(lines).orderBy("pos").collect():
        k = (r.run_id, r.source, (r.pos - 1) // 8)
        want[k] = (want.get(k, (r.start,))[0], r.end)
    got = {(r.run_id, r.source, r.block): (r.start, r.end) for r in spark.read.parquet(f"{path}/blocks").collect()}
    assert got == want


@pytest.mark.parametrize("size", [7, 100, 10**6])
def test_pages_equal_those_of_all_lines(spark, logs, size):
    lines, path = logs
    assert _all(logstore.pages(spark, path, size)) == _all(monitor.log_pages(lines, size))
    for end in (0, 10, 2049):
        before = spark.createDataFrame([("a", "run.log", end), ("b", "run.log", end // 2)], "run_id string, source string, before bigint")
        mine = lines.join(before.select("run_id", "source"), ["run_id", "source"], "left_semi")
        assert _all(logstore.pages(spark, path, size, before)) == _all(monitor.log_pages(mine, size, before))


def test_a_page_reads_only_its_blocks(spark, logs, tmp_path):
    lines, _ = logs
    path = str(tmp_path / "logs")
    logstore.write_lines(lines, path, block_lines=8, parts=16, segment_blocks=3)
    before = spark.createDataFrame([("a", "run.log", 2000)], "run_id string, source string, before bigint")
    want = _all(monitor.log_pages(lines.where("run_id = 'a'"), 100, before))
    shown = spark.read.parquet(f"{path}/blocks").where("run_id = 'a' AND start < 2000 AND end > 1900").select("part").distinct().collect()
    assert len(shown) == 1
    assert _spoil(f"{path}/lines", {f"part={r.part}" for r in shown}) >= 5
    assert _all(logstore.pages(spark, path, 100, before)) == want
    scan = logstore.pages(spark, path, 100, before)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#\d+ (IN|=|INSET)", scan) and re.search(r"block#\d+L? (IN|=|INSET)", scan)


RUNS = [("run-1", "completed"), ("run-12", "queued"), ("xyz", "running"), ("İx", "verify")]
FILES = [("run-1", "interaction_result.json"), ("run-1", "run.log"), ("run-12", "a/ß.txt"), ("xyz", "run.log"), ("xyz", "ab"), ("İx", "run.log")]
TEXTS = {("run-1", "run.log"): "STEP 1\nrare needle\n", ("xyz", "run.log"): "step 2\n😀 ab\nsplit nee\ndle\n", ("xyz", "verify.log"): "hidden\n", ("İx", "run.log"): "\n"}


def _tables(spark):
    status = spark.createDataFrame([(*r, float(i)) for i, r in enumerate(RUNS)], "run_id string, status string, created_at double")
    files = spark.createDataFrame(FILES, "run_id string, path string")
    return status, files, monitor.tail_lines(_lines(spark, TEXTS))


def test_search_equals_a_full_scan(spark, tmp_path):
    tables = _tables(spark)
    path = str(tmp_path / "ix")
    logstore.write_search_index(*tables, path, parts=8)
    texts = ["step", "needle", "nee", "NEEDLE rare", "a", "ab", "😀", "run.log", "run", "run-1", "ß", "hidden", "Queued", "i̇x", "zzz", "step 2 xyz", "", " ", "completed run-1", "nee zzz", "step step"]
    for mode in ("all", "run_id", "status", "files", "logs", "other"):
        for text in texts if mode == "all" else texts[:3]:
            for status in ("all", "running") if text == "step" else ("all",):
                got = logstore.search(spark, path, text, mode, status)
                assert _all(got.select("run_id", "status", "created_at")) == _all(monitor.search_runs(*tables, text, mode, status).select("run_id", "status", "created_at")), (mode, text, status)


def test_a_rare_word_reads_few_lines(spark, tmp_path):
    n = 400
    status = spark.range(n).select(F.format_string("run-%d", "id").alias("run_id"), F.lit("running").alias("status"))
    files = status.select("run_id", F.lit("run.log").alias("path"))
    lines = status.select("run_id", F.lit("run.log").alias("source"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(20).cast("bigint"))).alias("pos"))
    line = F.when((F.col("run_id") == "run-77") & (F.col("pos") == 5), "a xylophone").otherwise(F.concat(F.lit("plain words "), F.col("pos").cast("string")))
    tail = monitor.tail_lines(lines.withColumn("line", line))
    path = str(tmp_path / "ix")
    logstore.write_search_index(status, files, tail, path)
    part = spark.range(1).select(logstore._part(logstore.PARTS, F.lit("run-77"))).first()[0]
    for name in ("logs", "files", "runs"):
        assert _spoil(f"{path}/{name}", {f"part={part}"}) > 20
    found = logstore.search(spark, path, "XYLOPHONE")
    assert [r.run_id for r in found.collect()] == ["run-77"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#\d+ (IN|=|INSET)", plan) and "run-77" in plan


def test_a_text_is_lowered_once_and_tables_are_worked_out_once(spark, tmp_path):
    rows = [("Ab🤖b",), ("",), (None,), ("É" * 3,)]
    d = spark.createDataFrame(rows, "t string").select("t", logstore.pieces(F.col("t")).alias("p"))
    got = {r.t: set(r.p) for r in d.collect()}
    assert got == {"Ab🤖b": {"a", "b", "🤖", "ab", "b🤖", "🤖b", "ab🤖", "b🤖b"}, "": set(), None: set(), "ÉÉÉ": {"é", "éé", "ééé"}}
    assert d._jdf.queryExecution().analyzed().toString().count("lower(") == 1
    worked = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            worked.add(b.num_rows)
            yield b

    tail = spark.createDataFrame([("r1", "run.log", 1, "Ab"), ("r2", "run.log", 1, "cD")], "run_id string, source string, pos bigint, text string")
    status = spark.createDataFrame([("r1", "running"), ("r2", "queued")], "run_id string, status string")
    files = spark.createDataFrame([("r1", "run.log"), ("r1", "run.log"), ("r2", "run.log")], "run_id string, path string")
    path = str(tmp_path / "index")
    logstore.write_search_index(*(x.mapInArrow(told, x.schema) for x in (status, files, tail)), path, parts=4)
    assert worked.value == 7
    posted = spark.read.parquet(f"{path}/postings").drop("part")
    assert posted.where("scope = 'logs'").count() == 6 and posted.count() == posted.distinct().count()
    assert [r.run_id for r in logstore.search(spark, path, "CD", "logs").collect()] == ["r2"]
