"""Run-monitoring queries over logs and files derived from ``events``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom.functions.text import count_matches
from rolloom.operators import logstore, monitor
from rolloom.operators.ordered import number_rows, ranges, running_in
from rolloom.plans.registry import as_long, query, table
from rolloom.session import checkpointed, work_path

TAIL = 1_500


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of a user as one or two log lines of a run, in time order."""
    kind = F.col("event_type")
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    head = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" | "))
    k = F.get_json_object("props", "$.k")
    message = (
        F.when(kind == "click", F.concat(F.lit("interaction  | INFO     | ===== STEP "), k, F.lit(" =====")))
        .when(kind == "view", F.lit("interaction  | INFO     | 🤖 MODEL INPUT"))
        .when(kind == "error", F.concat(F.lit("runtime      | ERROR    | failed with value "), F.col("value").cast("string")))
        .when(kind == "signup", F.lit("environment  | INFO     | Beginning environment startup..."))
        .otherwise(F.lit("reward_spec  | INFO     | Eval report: {}"))
    )
    texts = F.when(kind == "view", F.array(F.concat(head, message), F.concat(F.lit("payload "), "props"))).otherwise(F.array(F.concat(head, message)))
    e = e.withColumn("_t", texts)
    e = ranges(e, ["ts", "event_id"], "_range")
    e = running_in(e, ["user_id"], ["ts", "event_id"], F.col("_range"), sums={"_end": F.size("_t")})
    source = F.when(F.pmod("user_id", F.lit(10)) == 9, "verify.log").otherwise("run.log")
    lines = e.select(
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"), source.alias("source"), (F.col("_end") - F.size("_t") + 1).alias("_first"), "ts", F.posexplode("_t").alias("_i", "line")
    ).select("run_id", "source", (F.col("_first") + F.col("_i")).alias("pos"), "line", "ts")
    return checkpointed(lines, "run-logs")  # stands for stored logs, read several times


def run_files(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """Log file of each run with its size, and a result file for each fourth user."""
    logs = lines.groupBy("run_id", "source").agg(
        F.sum(F.octet_length("line") + 1).alias("size"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("_u")
    )
    logs = logs.select("run_id", F.col("source").alias("path"), "size", (F.col("_u") / 1e6).alias("mtime"))
    users = table(spark, sf_dir, "events").where(F.pmod("user_id", F.lit(4)) == 0).groupBy("user_id").agg(F.sum(F.length("props")).alias("size"), F.max("event_id").cast("double").alias("mtime"))
    results = users.select(F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"), F.lit("interaction_result.json").alias("path"), "size", "mtime")
    return logs.unionByName(results)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").cast("double").alias("created_at"))
    return e.select(F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"), "created_at")


LINES_SQL = """
m AS (SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' | ' || CASE event_type
    WHEN 'click' THEN 'interaction  | INFO     | ===== STEP ' || json_extract_string(props, '$.k') || ' =====' WHEN 'view' THEN 'interaction  | INFO     | 🤖 MODEL INPUT'
    WHEN 'error' THEN 'runtime      | ERROR    | failed with value ' || value WHEN 'signup' THEN 'environment  | INFO     | Beginning environment startup...'
    ELSE 'reward_spec  | INFO     | Eval report: {}' END AS l1 FROM events),
ex AS (SELECT user_id, event_id, ts, 0 AS i, l1 AS line FROM m UNION ALL SELECT user_id, event_id, ts, 1, 'payload ' || props FROM m WHERE event_type = 'view'),
lines AS (SELECT 'run-' || user_id AS run_id, CASE WHEN user_id % 10 = 9 THEN 'verify.log' ELSE 'run.log' END AS source, line, ts,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, i) AS pos FROM ex),
files AS (SELECT run_id, source AS path, CAST(sum(strlen(line) + 1) AS BIGINT) AS size, max(epoch_us(ts)) / 1e6 AS mtime FROM lines GROUP BY ALL
  UNION ALL SELECT 'run-' || user_id, 'interaction_result.json', CAST(sum(length(props)) AS BIGINT), CAST(max(event_id) AS DOUBLE) FROM events WHERE user_id % 4 = 0 GROUP BY user_id),
runs AS (SELECT 'run-' || user_id AS run_id, CAST(min(event_id) AS DOUBLE) AS created_at FROM events GROUP BY user_id),
tail AS (SELECT * EXCLUDE (fe), right(line || chr(10), CAST(1500 - fe AS BIGINT)) AS text FROM (
  SELECT *, sum(length(line) + 1) OVER (PARTITION BY run_id, source ORDER BY pos DESC) - length(line) - 1 AS fe FROM lines) WHERE fe < 1500),
marks AS (SELECT run_id, max(CAST(regexp_matches(text, 'reward_spec|Eval report:|Beginning environment shutdown|Environment shutdown completed|num_turns:') AS INT)) AS v,
  max(CAST(regexp_matches(text, 'Beginning environment startup|Runtime initialized|STEP |MODEL INPUT|ACTION:') AS INT)) AS r,
  arg_max(CASE WHEN regexp_matches(text, 'STEP\\s+\\d+') THEN CAST(regexp_extract(text, '.*STEP\\s+(\\d+)', 1) AS BIGINT) END, pos) FILTER (regexp_matches(text, 'STEP\\s+\\d+')) AS current_step
  FROM tail WHERE source = 'run.log' GROUP BY run_id),
facts AS (SELECT run_id, max(CAST(path = 'interaction_result.json' AS INT)) AS res, max(CAST(path = 'run.log' AS INT)) AS lg, count(*) AS file_count, max(mtime) AS lu, max(size) FILTER (path = 'run.log') AS ls FROM files GROUP BY run_id),
status AS (SELECT runs.run_id, created_at, CASE WHEN res = 1 THEN 'completed' WHEN coalesce(lg, 0) = 0 THEN 'queued' WHEN v = 1 THEN 'verify' WHEN r = 1 THEN 'running' ELSE 'queued' END AS status,
  current_step, coalesce(file_count, 0) AS file_count, greatest(coalesce(lu, created_at), created_at) AS last_update, coalesce(ls, 0) AS run_log_size
  FROM runs LEFT JOIN facts USING (run_id) LEFT JOIN marks USING (run_id))
"""
_STATUS_COLS = ["run_id", "created_at", "status", "current_step", "file_count", "last_update", "run_log_size"]


def statuses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Status rows, files and log tails over one shared copy of the lines."""
    lines = log_lines(spark, sf_dir)
    files, tail = run_files(spark, sf_dir, lines), monitor.tail_lines(lines, TAIL)
    return monitor.run_status(runs(spark, sf_dir), files, tail), files, tail


@query("run_status", f"WITH {LINES_SQL} SELECT {', '.join(_STATUS_COLS)} FROM status")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statuses(spark, sf_dir)[0].select(*_STATUS_COLS)


@query(
    "run_snapshot",
    f"""WITH {LINES_SQL}
SELECT count(*) AS total, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'verify') AS verify,
  count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status IN ('running', 'verify')) AS active, coalesce(max(last_update), 0.0) AS most_recent_update
FROM status WHERE contains(run_id, 'n-1')""",
)
def run_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.run_stats(monitor.filter_runs(statuses(spark, sf_dir)[0], "N-1"))


@query("run_order", f"WITH {LINES_SQL} SELECT run_id, status, row_number() OVER (ORDER BY CAST(status = 'completed' AS INT), created_at, run_id) AS place FROM status")
def run_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every run in the order of display."""
    return number_rows(statuses(spark, sf_dir)[0], monitor.display_order(), "place").select("run_id", "status", "place")


@query("oldest_runs", f"WITH {LINES_SQL} SELECT run_id, created_at FROM status ORDER BY created_at, run_id LIMIT 20")
def oldest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty oldest runs."""
    return monitor.order_runs(statuses(spark, sf_dir)[0]).select("run_id", "created_at").limit(20)


@query("display_runs", f"WITH {LINES_SQL} SELECT run_id, status FROM status ORDER BY CAST(status = 'completed' AS INT), created_at, run_id LIMIT 20")
def display_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty runs shown first: completed ones last, else oldest first."""
    return monitor.order_for_display(statuses(spark, sf_dir)[0]).select("run_id", "status").limit(20)


#: What is searched for in each scope.
SEARCHES = {"all": 'VERIFY  {"k":', "run_id": "N-1 2", "status": "Unn", "files": "RESULT.json", "logs": "step 7"}


def _found_sql(scope: str, text: str) -> str:
    blob = "concat_ws(' ', b_run_id, b_status, b_files, b_logs)" if scope == "all" else f"b_{scope}"
    return f"SELECT '{scope}' AS scope, run_id, status FROM blob WHERE " + " AND ".join(f"contains({blob}, '{w}')" for w in text.lower().split())


@query(
    "run_search",
    f"""WITH {LINES_SQL},
blob AS (SELECT s.run_id, s.status, s.run_id AS b_run_id, lower(s.status || ' ' || s.status) AS b_status,
  coalesce((SELECT lower(string_agg(path, ' ')) FROM files f WHERE f.run_id = s.run_id), '') AS b_files,
  coalesce((SELECT lower(string_agg(text, '' ORDER BY pos)) FROM tail t WHERE t.run_id = s.run_id AND source = 'run.log'), '') AS b_logs FROM status s)
"""
    + " UNION ALL ".join(_found_sql(scope, text) for scope, text in SEARCHES.items()),
)
def run_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search in each scope, through the stored postings."""
    path = work_path(spark, "search")
    logstore.write_search_index(*statuses(spark, sf_dir), path)
    found = [logstore.search(spark, path, text, scope).select(F.lit(scope).alias("scope"), "run_id", "status") for scope, text in SEARCHES.items()]
    return reduce(DataFrame.union, found)


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files of all runs as of mid January, and files of the second half."""
    e = table(spark, sf_dir, "events")
    path = F.concat("event_type", F.lit("_"), F.get_json_object("props", "$.k"), F.when(F.col("event_type") == "error", ".verify.log").otherwise(".json"))
    f = e.select(F.col("user_id").alias("run_id"), path.alias("path"), F.length("props").alias("n"), "event_id", (F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).alias("early"))

    def files(df: DataFrame) -> DataFrame:
        return df.groupBy("run_id", "path").agg(F.sum("n").alias("size"), F.max("event_id").cast("double").alias("mtime"))

    return files(f.where("early")), files(f.where("not early and run_id % 50 <> 7 or event_id % 3 = 0 and run_id % 50 <> 7"))


_SNAP_SQL = """
f AS (SELECT user_id AS run_id, event_type || '_' || json_extract_string(props, '$.k') || CASE WHEN event_type = 'error' THEN '.verify.log' ELSE '.json' END AS path, length(props) AS n, event_id, ts < TIMESTAMP '2024-01-16' AS early FROM events),
prev AS (SELECT run_id, path, CAST(sum(n) AS BIGINT) AS size, CAST(max(event_id) AS DOUBLE) AS mtime FROM f WHERE early GROUP BY ALL),
cur AS (SELECT run_id, path, CAST(sum(n) AS BIGINT) AS size, CAST(max(event_id) AS DOUBLE) AS mtime FROM f WHERE (NOT early AND run_id % 50 <> 7) OR (event_id % 3 = 0 AND run_id % 50 <> 7) GROUP BY ALL),
ev AS (SELECT coalesce(p.run_id, c.run_id) AS run_id, coalesce(p.path, c.path) AS path,
   CASE WHEN c.size IS NULL THEN 'deleted' WHEN contains(coalesce(p.path, c.path), 'verify') THEN NULL WHEN p.size IS NULL THEN 'created' WHEN p.size <> c.size OR p.mtime <> c.mtime THEN 'modified' END AS action,
   coalesce(c.size, 0) AS size, coalesce(c.mtime, 99999999.0) AS updated_at FROM prev p FULL JOIN cur c ON p.run_id = c.run_id AND p.path = c.path),
events_out AS (SELECT * FROM ev WHERE action IS NOT NULL)
"""


@query("file_events", f"WITH {_SNAP_SQL} SELECT * FROM events_out")
def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.file_events(*snapshots(spark, sf_dir), F.lit(99999999.0))


@query("recent_file_events", f"WITH {_SNAP_SQL} SELECT run_id, path, action, row_number() OVER (PARTITION BY run_id ORDER BY updated_at DESC, path) AS recency FROM events_out QUALIFY recency <= 10")
def recent_file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = monitor.file_events(*snapshots(spark, sf_dir), F.lit(99999999.0))
    return as_long(monitor.recent_file_events(ev, 10).select("run_id", "path", "action", "recency"), "recency")


@query("removed_runs", f"WITH {_SNAP_SQL} SELECT DISTINCT run_id FROM prev WHERE run_id NOT IN (SELECT run_id FROM cur)")
def removed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.removed_runs(*snapshots(spark, sf_dir))


@query("event_cursor", "SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 4000) WHERE event_id > (SELECT max(event_id) - 1000 FROM events)")
def event_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    newest = e.agg(F.max("event_id")).first()[0] or 0
    return monitor.events_after(monitor.recent_events(e), newest - 1000)


@query(
    "run_merge",
    """SELECT 'run-' || user_id AS run_id, arg_max(event_type, event_id) AS status, max(event_id) AS seq FROM events GROUP BY user_id""",
)
def run_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"), F.col("event_type").alias("status"), F.col("event_id").alias("seq"))
    half = F.pmod("seq", F.lit(2)) == 0
    return monitor.merge_runs(e.where(half), e.where(~half))


@query(
    "run_cards",
    f"""WITH {LINES_SQL}, x AS (SELECT run_id, string_agg(text, '' ORDER BY pos) AS log_excerpt FROM tail WHERE source = 'run.log' GROUP BY run_id)
SELECT s.run_id, status, CASE status WHEN 'queued' THEN 'Queued' WHEN 'running' THEN 'Running' WHEN 'verify' THEN 'Verify' ELSE 'Completed' END AS status_label, file_count,
  md5(coalesce(log_excerpt, '')) AS excerpt_md5, (SELECT count(*) FROM files f WHERE f.run_id = s.run_id AND path LIKE '%.log') AS n_logs, (SELECT count(*) FROM files f WHERE f.run_id = s.run_id AND path LIKE '%.json') AS n_events
FROM status s LEFT JOIN x USING (run_id)""",
)
def run_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, files, tail = statuses(spark, sf_dir)
    created = monitor.file_events(files.limit(0), files, F.lit(0.0))
    cards = monitor.run_cards(status, files, tail, created)
    return cards.select("run_id", "status", "status_label", "file_count", F.md5("log_excerpt").alias("excerpt_md5"), "n_logs", F.coalesce(F.size("recent_file_events"), F.lit(0)).cast("bigint").alias("n_events"))


@query(
    "run_sources",
    f"WITH {LINES_SQL} SELECT run_id, path AS key, CASE WHEN path = 'run.log' THEN 'Run log' ELSE 'Verify log' END AS label, size FROM files WHERE path LIKE '%.log'",
)
def run_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of each run as its card lists them."""
    return monitor.log_sources(run_files(spark, sf_dir, log_lines(spark, sf_dir)))


# --- lines ------------------------------------------------------------------


@query(
    "log_parse",
    f"""WITH {LINES_SQL}, h AS (SELECT *, regexp_matches(line, '^\\d{{4}}-\\d{{2}}-\\d{{2}} ') AS hd FROM lines), r AS (SELECT *, sum(CAST(hd AS INT)) OVER (PARTITION BY run_id ORDER BY pos) AS record_id FROM h),
t AS (SELECT run_id, source, CAST(record_id AS BIGINT) AS record_id, max(CASE WHEN hd THEN substr(line, 1, 19) END) AS time, max(CASE WHEN hd THEN trim(split_part(line, ' | ', 2)) END) AS name,
  max(CASE WHEN hd THEN trim(split_part(line, ' | ', 3)) END) AS level, count(*) AS n_lines FROM r GROUP BY run_id, source, record_id HAVING level = 'INFO' OR level = 'ERROR')
SELECT t.*, pos - min(CASE WHEN hd THEN pos END) OVER (PARTITION BY r.run_id, r.source, r.record_id) + 1 AS line_no, CASE WHEN hd THEN split_part(line, ' | ', 4) ELSE line END AS line
FROM t JOIN r USING (run_id, source, record_id)""",
)
def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = log_lines(spark, sf_dir)
    keys = ["run_id", "source", "record_id"]
    return as_long(monitor.parse_run_log(lines, "INFO").join(monitor.record_lines(lines), keys), "line_no")


@query(
    "log_blocks",
    f"""WITH {LINES_SQL}, k AS (SELECT *, regexp_matches(line, '^\\d{{4}}-') AS hd, CASE WHEN contains(line, 'STEP ') THEN 'step' WHEN contains(line, 'MODEL INPUT') THEN 'input' ELSE '' END AS kind FROM lines),
b AS (SELECT *, CASE WHEN hd OR kind <> '' THEN '' ELSE coalesce(lag(kind) OVER (PARTITION BY run_id ORDER BY pos), '') END AS block FROM k)
SELECT run_id, source, pos, kind, block, 'log-line' || CASE WHEN contains(line, '| INFO') THEN ' level-info' ELSE '' END || CASE WHEN contains(line, '| ERROR') THEN ' level-error' ELSE '' END
  || CASE WHEN contains(line, '| reward_spec') THEN ' name-reward_spec' ELSE '' END || CASE WHEN contains(line, '| interaction') THEN ' name-interaction' ELSE '' END
  || CASE WHEN contains(line, '| environment') OR contains(line, '| runtime') THEN ' name-environment' ELSE '' END
  || CASE WHEN kind <> '' THEN ' kind-' || kind || ' kind-header' WHEN block <> '' THEN ' kind-' || block || ' kind-body' WHEN hd THEN ' kind-system' ELSE '' END AS classes,
  len(string_split(lower(line), 'st')) - 1 AS n_matches FROM b""",
)
def log_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = monitor.classify_lines(log_lines(spark, sf_dir))
    return c.select("run_id", "source", "pos", "kind", "block", "classes", count_matches(F.col("line"), "st").cast("bigint").alias("n_matches"))


@query(
    "log_pages",
    f"""WITH {LINES_SQL}, o AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY run_id ORDER BY pos) AS e FROM lines),
z AS (SELECT run_id, source, max(e) AS size, greatest(max(e) - 2000, 0) AS a FROM o GROUP BY ALL),
n AS (SELECT run_id, source, any_value(size) AS size, CASE WHEN any_value(a) > 0 THEN min(e) FILTER (e > a) ELSE 0 END AS st FROM z JOIN o USING (run_id, source) GROUP BY run_id, source)
SELECT run_id, source, CASE WHEN source = 'run.log' THEN 'Run log' ELSE 'Verify log' END AS label, CAST(size AS BIGINT) AS file_size, CAST(st AS BIGINT) AS start_offset, CAST(size AS BIGINT) AS end_offset, st > 0 AS has_more,
  md5(coalesce(string_agg(line || chr(10), '' ORDER BY pos) FILTER (e > st), '')) AS text_md5
FROM n JOIN o USING (run_id, source) GROUP BY run_id, source, size, st""",
)
def log_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last page of every log, from the blocks that it shows."""
    path = work_path(spark, "logs")
    logstore.write_lines(log_lines(spark, sf_dir).drop("ts"), path, block_lines=16)
    p = logstore.pages(spark, path, 2000)
    return p.select("run_id", "source", "label", "file_size", "start_offset", "end_offset", "has_more", F.md5("text").alias("text_md5"))
