import os

import pytest
from pyspark.sql import functions as F

from rolloom.operators import monitor
from rolloom.sources.tail import RunLogReader, _aligned, follows, range_text
from rolloom.streaming import monitor_stream as ms


def _put(root, run, name, text, mode="w"):
    os.makedirs(f"{root}/{run}", exist_ok=True)
    with open(f"{root}/{run}/{name}", mode, encoding="utf-8") as f:
        f.write(text)


def test_follow_growth_truncation_deletion_and_removal(spark, tmp_path):
    root, out, ckpt = (str(tmp_path / x) for x in ("logs", "out", "ckpt"))

    def step():
        q = ms.follow(spark, root, out, ckpt, max_chars=60)
        q.awaitTermination()
        return {r.run_id: r for r in ms.latest_runs(spark, out).collect()}

    _put(root, "a", "run.log", "Beginning environment startup...\n")
    _put(root, "v", "run.log", "Beginning environment startup...\n")
    _put(root, "v", "verify.log", "verify output\n")
    os.makedirs(f"{root}/empty")
    runs = step()
    assert {k: r.status for k, r in runs.items()} == {"a": "running", "v": "running", "empty": "queued"}
    assert runs["v"].file_count == 2

    _put(root, "a", "run.log", "2026-01-01 00:00:01 | interaction  | INFO     | STEP 1\n", "a")
    _put(root, "v", "interaction_result.json", "{}")
    runs = step()
    assert runs["a"].current_step == 1 and runs["v"].status == "completed"
    assert runs["a"].tail == ("Beginning environment startup...\n2026-01-01 00:00:01 | interaction  | INFO     | STEP 1\n")[-60:]

    _put(root, "a", "run.log", "STEP 9\n")  # shorter: read again from the start, tail kept
    os.remove(f"{root}/v/run.log")
    os.remove(f"{root}/v/interaction_result.json")
    runs = step()
    assert runs["a"].current_step == 9 and runs["a"].tail.endswith("STEP 1\nSTEP 9\n")
    assert (runs["v"].status, runs["v"].tail, runs["v"].current_step) == ("queued", "", None)

    os.rmdir(f"{root}/empty")
    assert set(step()) == {"a", "v"}
    ev = ms.stored_events(spark, out)
    changes = [(r.run_id, r.batch_id, r.status) for r in ev.where("event_type = 'status_changed'").orderBy("batch_id", "run_id").collect()]
    assert changes == [("a", 0, "running"), ("v", 0, "running"), ("v", 1, "completed"), ("v", 2, "queued")]
    assert ev.where("event_type = 'run_removed'").count() == 1
    files = [(r.run_id, r.batch_id, r.path, r.action) for r in ev.where("event_type = 'file_changed'").orderBy("batch_id", "path").collect()]
    assert files == [("v", 1, "interaction_result.json", "created"), ("v", 2, "interaction_result.json", "deleted"), ("v", 2, "run.log", "deleted")]
    grown = [(r.run_id, r.batch_id, r.path, r.tail) for r in ev.where("event_type = 'log_append' AND batch_id > 0").orderBy("batch_id").collect()]
    assert [g[:3] for g in grown] == [("a", 1, "run.log"), ("a", 2, "run.log")] and grown[1][3] == "STEP 9\n"
    assert ms.stored_events_after(ev, 1, 1 << 60).where("batch_id < 2").count() == 0


def _batch(spark, rows):
    shape = "run_id string, event_type string, status string, current_step bigint, file_count bigint, tail string, updated_at double, path string, action string"
    return spark.createDataFrame([(r, k, s, None, 1, "", 1.0, None, None) for r, k, s in rows], shape)


def test_a_reader_sees_whole_batches(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    runs = [f"r{i}" for i in range(40)]
    look = lambda: {r.status for r in ms.latest_runs(spark, out).collect()}
    with pytest.raises(FileNotFoundError):
        ms.latest_runs(spark, out)
    ms.write_batch(_batch(spark, [(r, "run_update", "queued") for r in runs]), 0, out)
    assert look() == {"queued"}

    def broken(*_):
        raise OSError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(ms, "_commit", broken)
        with pytest.raises(OSError):
            ms.write_batch(_batch(spark, [(r, "run_update", "running") for r in runs]), 1, out)
    # the folders of the second batch are there, its manifest is not
    assert look() == {"queued"} and ms.stored_events(spark, out).select("batch_id").distinct().count() == 1
    before = ms.latest_runs(spark, out)
    ms.write_batch(_batch(spark, [(r, "run_update", "running") for r in runs[:35]] + [(r, "run_removed", None) for r in runs[35:]]), 1, out)
    assert look() == {"running"} and ms.latest_runs(spark, out).count() == 35
    assert {r.status for r in before.collect()} == {"queued"} and before.count() == 40  # a reader between two batches
    ms.write_batch(_batch(spark, [(r, "run_update", "verify") for r in runs]), 1, out)  # a batch is committed once
    assert look() == {"running"}
    ms.write_batch(_batch(spark, [("r0", "run_update", "verify")]), 2, out, keep=1, grace=0.0)
    assert look() == {"running", "verify"} and ms.latest_runs(spark, out).count() == 35
    assert [b for b, _ in ms._manifests(spark, out)] == [2]
    kept = {p.name for p in (tmp_path / "out" / "runs").glob("bucket=*/batch_id=*")}
    assert kept == {"batch_id=1", "batch_id=2"}
    ms.write_batch(_batch(spark, []), 3, out)
    assert ms.latest_runs(spark, out).count() == 35


def test_one_rule_for_log_names(spark):
    names = ["run.log", "RUN.LOG", "a/run.log", "verify.log", "x/Verify/y.TXT", "eval.txt", "evaluate.json", "my.log", "run.log\n", "verify.log\n", "log.eval", "é eval\n.log"]
    got = spark.createDataFrame([(n,) for n in names], "p string").select("p", monitor.is_log(F.col("p")).alias("l")).collect()
    low = lambda n: n.lower()
    want = {n: low(n) == "run.log" or (low(n).endswith((".log", ".txt")) and ("verify" in low(n) or "eval" in low(n))) for n in names}
    assert {r.p: r.l for r in got} == want == {n: follows(n) for n in names}


def _read(reader, start, end):
    return [x for p in reader.partitions(start, end) for x in reader.read(p)]


def test_ranges_do_not_split_characters(tmp_path):
    text = "aé€😀" * 50
    _put(str(tmp_path / "logs"), "r", "run.log", text)
    root = f"file:{tmp_path}/logs"
    for size in (1, 2, 3, 5, 64):
        reader = RunLogReader({"path": root, "rangebytes": str(size), "offsets": f"file:{tmp_path}/o{size}"})
        rows = [r for r in _read(reader, reader.initialOffset(), reader.latestOffset()) if r[2] == "log"]
        assert "".join(range_text(root, r[0], r[1], *r[4:7]) for r in sorted(rows, key=lambda r: r[4])) == text
    assert _aligned(b"ab", 0, True, 2) == b"ab"


def test_versions_tell_changes_once_and_again_alike(tmp_path):
    root = str(tmp_path / "logs")
    for i in range(30):
        _put(root, f"r{i}", "run.log", "x\n")
    options = {"path": f"file:{root}", "shares": "4"}
    reader = RunLogReader(options)
    zero, one = reader.initialOffset(), reader.latestOffset()
    assert (zero, one) == ({"version": 0}, {"version": 1}) and len(reader.partitions(zero, one)) == 4
    first = _read(reader, zero, one)
    assert len(first) == 60 and {r[2:4] for r in first} == {("run", "created"), ("log", "append")}
    _put(root, "r7", "run.log", "more\n", "a")
    _put(root, "r8", "a/b.json", "{}") if os.makedirs(f"{root}/r8/a") is None else None
    # a batch that is run again, also by a new reader with other settings, tells what it told before
    again = RunLogReader({**options, "shares": "9"})
    assert _read(again, zero, one) == first
    two = again.latestOffset()
    assert sorted(r[:6] for r in _read(again, one, two)) == [("r7", "run.log", "log", "append", 2, 7), ("r8", "a/b.json", "file", "created", 0, 2)]
    os.remove(f"{root}/r7/run.log")
    os.rmdir(f"{root}/r7")
    three = reader.latestOffset()
    assert sorted(r[:4] for r in _read(reader, two, three)) == [("r7", "", "run", "deleted"), ("r7", "run.log", "log", "deleted")]
    assert _read(reader, three, reader.latestOffset()) == [] and reader.partitions(three, three) == []
    reader.commit(three)
    assert reader._versions() == [2, 3, 4]


def test_a_share_that_failed_lists_anew_and_the_others_do_not(tmp_path):
    root = str(tmp_path / "logs")
    for i in range(20):
        _put(root, f"r{i}", "run.log", "x\n")
    reader = RunLogReader({"path": f"file:{root}", "shares": "3"})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    done = [list(reader.read(p)) for p in parts[:2]]
    for i in range(20, 40):
        _put(root, f"r{i}", "run.log", "x\n")
    assert [list(reader.read(p)) for p in parts[:2]] == done
    late = list(reader.read(parts[2]))
    rest = _read(reader, {"version": 1}, {"version": 2})
    told = [r[0] for rows in [*done, late, rest] for r in rows if r[2] == "log"]
    assert sorted(told) == sorted(f"r{i}" for i in range(40))


def test_shares_do_not_follow_the_shuffle_partitions(spark, tmp_path):
    import json

    from rolloom.sources.tail import SHARES

    root, out, ckpt = (str(tmp_path / x) for x in ("logs", "out", "ckpt"))
    for i in range(SHARES * 3):
        _put(root, f"r{i}", "run.log", "STEP 1\n")
    key, old = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(key, "3")
    try:
        ms.follow(spark, root, out, ckpt, rangebytes="3").awaitTermination()
        # every range of a batch reaches the tail, which is stored once
        got = {r.run_id: (r.tail, r.file_count, r.status) for r in ms.latest_runs(spark, out).collect()}
    finally:
        spark.conf.set(key, old)
    assert got == {f"r{i}": ("STEP 1\n", 1, "running") for i in range(SHARES * 3)}
    with open(f"{ckpt}-listing/shares.json") as f:
        assert json.load(f) == SHARES


def test_logs_are_written_whole_by_a_fixed_number_of_tasks(spark, tmp_path):
    from rolloom.plans import streams

    rows = [(f"r{i}", "run.log", p, f"é {i} {p}") for i in range(20) for p in range(7)] + [(None, "run.log", 1, "lost")]
    lines = spark.createDataFrame(rows, "run_id string, source string, pos bigint, line string")
    key, old = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "3")  # a log is in several batches
    try:
        streams.write_logs(lines, str(tmp_path / "logs"))
        streams.write_logs(lines, str(tmp_path / "logs"))
    finally:
        spark.conf.set(key, old)
    got = {d: (tmp_path / "logs" / d / "run.log").read_text() for d in os.listdir(tmp_path / "logs")}
    assert got == {f"r{i}": "".join(f"é {i} {p}\n" for p in range(7)) for i in range(20)} and not os.listdir(f"{tmp_path}/logs-drafts")
    streams.remove_runs(lines.where("run_id < 'r15'").select("run_id").distinct(), str(tmp_path / "logs"))
    assert sorted(os.listdir(tmp_path / "logs")) == sorted(r for r in got if r >= "r15")
