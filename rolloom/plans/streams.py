"""Stream queries: logs derived from ``events`` grow in two steps and are followed by the monitor."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom.plans.monitoring import LINES_SQL, log_lines
from rolloom.plans.episodes import event_steps
from rolloom.plans.registry import as_long, query, table
from rolloom.session import work_path
from rolloom.sources import files
from rolloom.sources.store import open_store, qualified
from rolloom.streaming import monitor_stream

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TAIL = 1_500


def write_logs(lines: DataFrame, root: str) -> None:
    """Write each run's lines to its log file, as the run's own logger would: one writer per file.

    Rows stream through in order and are never collected. A file is written whole under
    another name and renamed, so a retried task leaves the same file. Files are dealt to a
    fixed number of tasks: what they cost is their number, not the bytes that partitions are
    joined by.
    """
    root = qualified(lines.sparkSession, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, base = open_store(root)
        at, out, draft = None, None, ""

        def finish() -> None:
            out.close()
            path = f"{base}/{at[0]}/{at[1]}"
            if system.get_file_info(path).is_file:
                system.delete_file(path)
            system.move(draft, path)

        for batch in batches:
            for log, rows in groupby(zip(*(c.to_pylist() for c in batch.columns), strict=True), key=itemgetter(0, 1)):
                if None in log:
                    continue
                if at != log:
                    if out is None:
                        system.create_dir(f"{base}-drafts", recursive=True)
                    else:
                        finish()
                    at = log
                    system.create_dir(f"{base}/{log[0]}", recursive=True)
                    draft = f"{base}-drafts/{uuid.uuid4().hex}"
                    out = system.open_output_stream(draft)
                out.write("".join(line + "\n" for _, _, line in rows).encode())
        if out is not None:
            finish()
        yield pa.RecordBatch.from_pydict({"done": [True]})

    ordered = lines.repartition(_tasks(lines), "run_id", "source").sortWithinPartitions("run_id", "source", "pos")
    ordered.select("run_id", "source", "line").mapInArrow(run, "done boolean").write.format("noop").mode("overwrite").save()


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def remove_runs(runs: DataFrame, root: str) -> None:
    """Delete the directories of ``runs(run_id)``, as a clean-up would."""
    root = qualified(runs.sparkSession, root)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = open_store(root)
        for f in frames:
            for run_id in f["run_id"]:
                system.delete_dir(f"{base}/{run_id}")
        yield pd.DataFrame({"done": [True]})

    runs.repartition(_tasks(runs), "run_id").mapInPandas(run, "done boolean").write.format("noop").mode("overwrite").save()


def followed(spark: SparkSession, sf_dir: str, remove: Column | None = None) -> str:
    """Run the monitor over the first half of January, then over the whole month; returns its output folder.

    With ``remove``, a condition on ``run_id``, a last step follows the removal of those runs.
    """
    conf = spark.conf
    key = "spark.sql.streaming.stateStore.providerClass"
    old = conf.get(key, None)
    conf.set(key, ROCKS)
    try:
        base = work_path(spark, "stream")
        root, out, ckpt = f"{base}/logs", f"{base}/out", f"{base}/ckpt"
        lines = log_lines(spark, sf_dir)
        early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
        write_logs(lines.where(early), root)
        monitor_stream.follow(spark, root, out, ckpt, max_chars=TAIL).awaitTermination()
        write_logs(lines, root)  # each log as it is now: longer than before
        results = table(spark, sf_dir, "events").where(F.pmod("user_id", F.lit(4)) == 0).select("user_id").distinct()
        results = results.select(F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"), F.lit("interaction_result.json").alias("source"), F.lit(1).alias("pos"), F.lit("{}").alias("line"))
        write_logs(results, root)
        monitor_stream.follow(spark, root, out, ckpt, max_chars=TAIL).awaitTermination()
        if remove is not None:
            remove_runs(lines.select("run_id").distinct().where(remove), root)
            monitor_stream.follow(spark, root, out, ckpt, max_chars=TAIL).awaitTermination()
        return out
    finally:
        conf.set(key, old) if old else conf.unset(key)


@query(
    "stream_status",
    f"""WITH {LINES_SQL}, x AS (SELECT run_id, string_agg(text, '' ORDER BY pos) AS log_excerpt FROM tail WHERE source = 'run.log' GROUP BY run_id)
SELECT run_id, status, current_step, file_count, md5(coalesce(log_excerpt, '')) AS tail_md5 FROM status LEFT JOIN x USING (run_id)""",
)
def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = monitor_stream.latest_runs(spark, followed(spark, sf_dir))
    return runs.select("run_id", "status", "current_step", "file_count", F.md5("tail").alias("tail_md5"))


@query(
    "stream_events",
    f"""WITH {LINES_SQL},
n AS (SELECT run_id, count(*) FILTER (ts < TIMESTAMP '2024-01-16') > 0 AS b0, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') > 0 AS l1, CAST(substr(run_id, 5) AS BIGINT) % 4 = 0 AS f1,
  CAST(substr(run_id, 5) AS BIGINT) % 10 = 3 AS gone FROM lines GROUP BY run_id),
early AS (SELECT run_id, source, right(line || chr(10), CAST({TAIL} - fe AS BIGINT)) AS text FROM (
  SELECT *, sum(length(line) + 1) OVER (PARTITION BY run_id, source ORDER BY pos DESC) - length(line) - 1 AS fe FROM lines WHERE ts < TIMESTAMP '2024-01-16') WHERE fe < {TAIL}),
first AS (SELECT run_id, CASE WHEN NOT bool_or(source = 'run.log') THEN 'queued'
  WHEN bool_or(source = 'run.log' AND regexp_matches(text, 'reward_spec|Eval report:|Beginning environment shutdown|Environment shutdown completed|num_turns:')) THEN 'verify'
  WHEN bool_or(source = 'run.log' AND regexp_matches(text, 'Beginning environment startup|Runtime initialized|STEP |MODEL INPUT|ACTION:')) THEN 'running' ELSE 'queued' END AS was FROM early GROUP BY run_id),
moved AS (SELECT run_id, coalesce(was, 'queued') AS was, status FROM status LEFT JOIN first USING (run_id))
SELECT event_type, batch_id, n FROM (
  SELECT 'run_update' AS event_type, 0 AS batch_id, count(*) FILTER (b0) AS n FROM n
  UNION ALL SELECT 'run_update', 1, count(*) FILTER (l1 OR f1) FROM n UNION ALL SELECT 'log_append', 0, count(*) FILTER (b0) FROM n
  UNION ALL SELECT 'log_append', 1, count(*) FILTER (l1) FROM n UNION ALL SELECT 'file_changed', 1, count(*) FILTER (f1) FROM n
  UNION ALL SELECT 'status_changed', 0, count(*) FILTER (was <> 'queued') FROM moved UNION ALL SELECT 'status_changed', 1, count(*) FILTER (was <> status) FROM moved
  UNION ALL SELECT 'run_removed', 2, count(*) FILTER (gone) FROM n)""",
)
def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all five kinds per batch; in the third one each tenth run is gone."""
    out = followed(spark, sf_dir, remove=F.pmod(F.substring("run_id", 5, 20).cast("bigint"), F.lit(10)) == 3)
    ev = monitor_stream.stored_events_after(monitor_stream.stored_events(spark, out), -1, -1)
    return ev.groupBy("event_type", "batch_id").agg(F.count("*").alias("n"))


@query("run_directories", f"WITH {LINES_SQL} SELECT run_id, source AS path, CAST(sum(strlen(line) + 1) AS BIGINT) AS size FROM lines GROUP BY run_id, source")
def run_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run directories with their logs, scanned."""
    root = work_path(spark, "run-dirs")
    write_logs(log_lines(spark, sf_dir), root)
    return files.scan_runs(spark, root).select("run_id", "path", "size")


@query("trajectory_files", "SELECT CAST(user_id AS VARCHAR) AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord, event_id AS step_idx, event_type AS action, value AS execution_time FROM events")
def trajectory_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a trajectory file, one step a line, read back as steps."""
    steps = event_steps(spark, sf_dir)
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("action"))
    last = steps.groupBy("run_id").agg(F.max("step_idx").alias("last"))
    body = steps.join(e, "event_id").join(last, "run_id")
    step = F.to_json(F.struct(F.col("event_id").alias("step_idx"), "action", "execution_time"))
    line = F.concat(F.when(F.col("step_idx") == 1, '{"trajectory":[').otherwise(","), step, F.when(F.col("step_idx") == F.col("last"), "]}").otherwise(""))
    rows = body.select(F.col("run_id").cast("string").alias("run_id"), F.lit("interaction_result.json").alias("source"), F.col("step_idx").alias("pos"), line.alias("line"))
    root = work_path(spark, "trajectories")
    write_logs(rows, root)
    return as_long(files.read_trajectories(spark, root).select("run_id", "ord", "step_idx", "action", "execution_time"), "ord", "step_idx")
