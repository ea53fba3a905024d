"""Run monitoring over snapshots: status, tails, file events, log lines and pages.

Logs are tables of lines, ``run_id, source, pos, line`` with 1-based positions; a line
counts its characters plus one newline. Nothing assembles a whole log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rolloom.operators.ordered import running

# Markers, file names, labels and limits.
STATUS_LABELS = {"queued": "Queued", "running": "Running", "verify": "Verify", "completed": "Completed"}
RESULT_FILE = "interaction_result.json"
RUN_LOG = "run.log"
# files followed as logs; the pattern means the same to Spark and to Python, which plans reads by it
LOG_NAME = r"(?is)\A(?:run\.log|.*(?:verify|eval).*\.(?:log|txt))(?!.)"
VERIFY_MARKERS = ["reward_spec", "Eval report:", "Beginning environment shutdown", "Environment shutdown completed", "num_turns:"]
RUNNING_MARKERS = ["Beginning environment startup", "Runtime initialized", "STEP ", "MODEL INPUT", "ACTION:"]
STEP_PATTERN = r"STEP\s+(\d+)"
MAX_TAIL_CHARS = 60_000
MAX_FILE_EVENTS = 80
MAX_EVENTS = 4_000
PAGE_BYTES = 64_000
DATED = r"\A\d{4}-\d{2}-\d{2}"
HEADER = r"\A(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) \| (.{12,}?) \| (.{8,}?) \| (.*)\z"
LEVELS = {"TRACE": 5, "DEBUG": 10, "INFO": 20, "SUCCESS": 25, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}
KIND_MARKERS = {
    "step": ["STEP "],
    "thought": ["THOUGHT:", "💭 THOUGHT"],
    "action": ["ACTION:", "🎬 ACTION"],
    "input": ["MODEL INPUT"],
    "observation": ["Observation:"],
}
LEVEL_CLASSES = ["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"]
NAME_CLASSES = {
    "reward_spec": ["| reward_spec"],
    "interaction": ["| interaction"],
    "agent-loop": ["| agent-loop"],
    "environment": ["| environment", "| deployment", "| runtime"],
}


def _has_any(c: Column, words: list[str]) -> Column:
    out = c.contains(words[0])
    for w in words[1:]:
        out = out | c.contains(w)
    return out


# --- names and status -------------------------------------------------------


def is_log(path: Column) -> Column:
    """Whether a file is followed as a log."""
    return path.rlike(LOG_NAME)


def log_label(path: Column) -> Column:
    """Display name of a log."""
    low = F.lower(path)
    return F.when(low == RUN_LOG, "Run log").when(_has_any(low, ["verify", "eval"]), "Verify log").otherwise(F.substring_index(path, "/", -1))


def status_of(has_result: Column, has_log: Column, in_verify: Column, in_running: Column) -> Column:
    """Status from four facts, in order of precedence."""
    return (
        F.when(has_result, "completed").when(~has_log, "queued").when(in_verify, "verify").when(in_running, "running").otherwise("queued")
    )


def text_status(file_names: Column, tail: Column) -> Column:
    """Status from a list of file names and the log tail as text."""
    return status_of(
        F.array_contains(file_names, RESULT_FILE), F.array_contains(file_names, RUN_LOG), _has_any(tail, VERIFY_MARKERS), _has_any(tail, RUNNING_MARKERS)
    )


def current_step(tail: Column) -> Column:
    """Number of the last step heading, or null."""
    return F.try_element_at(F.regexp_extract_all(tail, F.lit(STEP_PATTERN), F.lit(1)), F.lit(-1)).cast("bigint")


def tail_lines(lines: DataFrame, max_chars: int = MAX_TAIL_CHARS) -> DataFrame:
    """Lines, or parts of lines, within the last ``max_chars`` characters of each log.

    A line counts one character at least, so only the last ``max_chars`` lines are ordered.
    """
    size = F.length("line") + 1
    last = lines.groupBy("run_id", "source").agg(F.max("pos").alias("_last"))
    near = lines.join(last, ["run_id", "source"]).where(F.col("pos") > F.col("_last") - max_chars).select(*lines.columns)
    back = running(near.withColumn("_back", -F.col("pos")), ["run_id", "source"], "_back", sums={"_end": size})
    room = F.lit(max_chars) - (F.col("_end") - size)
    kept = back.where(room > 0)
    return kept.withColumn("text", F.right(F.concat("line", F.lit("\n")), room.cast("int"))).drop("_back", "_end")


def tail_text(tail: DataFrame) -> DataFrame:
    """Tail of each log as one text; its length is bounded by the tail limit."""
    part = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return tail.groupBy("run_id", "source").agg(F.array_join(F.transform(part, lambda p: p["text"]), "").alias("tail"))


def run_status(runs: DataFrame, files: DataFrame, tail: DataFrame) -> DataFrame:
    """Status, step and sizes per run.

    ``runs(run_id, created_at)``, ``files(run_id, path, size, mtime)``, ``tail`` from
    :func:`tail_lines`. All facts are map-side combined aggregates.
    """
    has = files.groupBy("run_id").agg(
        F.max(F.col("path") == RESULT_FILE).alias("_result"),
        F.max(F.col("path") == RUN_LOG).alias("_log"),
        F.count("path").alias("file_count"),
        F.max("mtime").alias("last_update"),
        F.max(F.when(F.col("path") == RUN_LOG, F.col("size"))).alias("run_log_size"),
    )
    step = current_step(F.col("text"))
    marks = tail.where(F.col("source") == RUN_LOG).groupBy("run_id").agg(
        F.max(_has_any(F.col("text"), VERIFY_MARKERS)).alias("_verify"),
        F.max(_has_any(F.col("text"), RUNNING_MARKERS)).alias("_running"),
        F.max_by(step, F.when(step.isNotNull(), F.col("pos"))).alias("current_step"),
    )
    j = runs.join(has, "run_id", "left").join(marks, "run_id", "left")
    fact = {c: F.coalesce(c, F.lit(False)) for c in ("_result", "_log", "_verify", "_running")}
    status = status_of(fact["_result"], fact["_log"], fact["_verify"], fact["_running"])
    out = j.withColumns(
        {
            "status": status,
            "file_count": F.coalesce("file_count", F.lit(0)),
            "run_log_size": F.coalesce("run_log_size", F.lit(0)),
            "last_update": F.greatest(F.coalesce("last_update", F.col("created_at")), F.col("created_at")),
        }
    )
    return out.drop(*fact)


def status_label(status: Column) -> Column:
    """Display label of a status."""
    return F.create_map(*[F.lit(x) for kv in STATUS_LABELS.items() for x in kv])[status]


def run_stats(runs: DataFrame) -> DataFrame:
    """Counters over runs with ``status, last_update`` (epoch seconds)."""
    s = F.col("status")
    counts = {k: F.count_if(s == k) for k in STATUS_LABELS}
    return runs.agg(
        F.count("*").alias("total"),
        *[c.alias(k) for k, c in counts.items()],
        F.count_if(s.isin("running", "verify")).alias("active"),
        F.coalesce(F.max("last_update"), F.lit(0.0)).alias("most_recent_update"),
    )


def filter_runs(runs: DataFrame, text: str = "", status: str = "all") -> DataFrame:
    """Runs whose id contains ``text`` (any case) and whose status matches."""
    if text:
        runs = runs.where(F.lower("run_id").contains(text.lower()))
    return runs if status == "all" else runs.where(F.col("status") == status)


def order_runs(runs: DataFrame) -> DataFrame:
    """Oldest first, ties by id."""
    return runs.orderBy("created_at", "run_id")


def display_order() -> list[Column]:
    """Completed runs last, otherwise oldest first, ties by id."""
    return [F.col("status") == "completed", F.col("created_at"), F.col("run_id")]


def order_for_display(runs: DataFrame) -> DataFrame:
    """Completed runs last, otherwise oldest first."""
    return runs.orderBy(*display_order())


def search_runs(runs: DataFrame, files: DataFrame, tail: DataFrame, text: str, mode: str = "all", status: str = "all") -> DataFrame:
    """Runs in which every keyword occurs, within the scope ``mode``.

    A keyword has no whitespace and the searched pieces are joined by spaces or line
    ends, so a hit lies in a single file name or line; per-keyword flags are combined
    on the map side instead of building each run's search text.
    """
    words = text.lower().split()
    kept = filter_runs(runs, status=status)
    if not words:
        return kept
    own = {"run_id": ["run_id"], "status": ["status", "_label"], "all": ["run_id", "status", "_label"]}.get(mode, [])
    hits = kept.withColumn("_label", status_label(F.col("status")))
    direct = [F.lit(False) for _ in words]
    for c in own:
        direct = [d | F.lower(c).contains(w) for d, w in zip(direct, words, strict=True)]
    flags = {f"_w{i}": d for i, d in enumerate(direct)}
    hits = hits.withColumns(flags).drop("_label")
    for scope, side, column in (("files", files, "path"), ("logs", tail.where(F.col("source") == RUN_LOG), "text")):
        if mode in (scope, "all"):
            found = side.groupBy("run_id").agg(*[F.max(F.lower(column).contains(w)).alias(f"_f{i}") for i, w in enumerate(words)])
            hits = hits.join(found, "run_id", "left")
            hits = hits.withColumns({f"_w{i}": F.col(f"_w{i}") | F.coalesce(f"_f{i}", F.lit(False)) for i in range(len(words))})
            hits = hits.drop(*[f"_f{i}" for i in range(len(words))])
    for w in flags:
        hits = hits.where(w)
    return hits.drop(*flags)


# --- file events ------------------------------------------------------------


def file_events(prev: DataFrame, cur: DataFrame, now: Column) -> DataFrame:
    """Created, modified and deleted files between two snapshots ``run_id, path, size, mtime``.

    Logs report appended text instead of creation or change, but their deletion counts.
    """
    p = prev.select("run_id", "path", F.col("size").alias("_s"), F.col("mtime").alias("_m"))
    j = p.join(cur, ["run_id", "path"], "full_outer")
    differs = (F.col("_s") != F.col("size")) | (F.col("_m") != F.col("mtime"))
    action = (
        F.when(F.col("size").isNull(), "deleted")
        .when(is_log(F.col("path")), None)
        .when(F.col("_s").isNull(), "created")
        .when(differs, "modified")
    )
    gone = F.col("size").isNull()
    return j.select(
        "run_id", "path", action.alias("action"), F.when(gone, 0).otherwise(F.col("size")).alias("size"), F.when(gone, now).otherwise(F.col("mtime")).alias("updated_at")
    ).where(F.col("action").isNotNull())


def removed_runs(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """Run ids that vanished, in id order."""
    return prev.select("run_id").distinct().join(cur.select("run_id").distinct(), "run_id", "left_anti").orderBy("run_id")


def recent_file_events(events: DataFrame, n: int = MAX_FILE_EVENTS) -> DataFrame:
    """Newest ``n`` file events per run with ``recency`` 1 for the newest."""
    w = W.partitionBy("run_id").orderBy(F.desc("updated_at"), "path")
    return events.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def recent_events(events: DataFrame, n: int = MAX_EVENTS) -> DataFrame:
    """Newest ``n`` events overall by id."""
    return events.orderBy(F.desc("event_id")).limit(n)


def events_after(events: DataFrame, cursor: int) -> DataFrame:
    """Events behind a cursor; the filter reaches the scan."""
    return events.where(F.col("event_id") > cursor)


def merge_runs(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Latest row per run by ``seq``."""
    both = current.unionByName(updates)
    rest = [c for c in both.columns if c != "run_id"]
    return both.groupBy("run_id").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("run_id", "r.*")


def run_cards(status: DataFrame, files: DataFrame, tail: DataFrame, events: DataFrame) -> DataFrame:
    """Run cards: status row plus label, log tail and newest file events.

    Collected values are bounded: the tail by its limit, events by 80, log sources by
    the few names that count as logs; file names stay in the ``files`` table.
    """
    texts = tail_text(tail.where(F.col("source") == RUN_LOG)).select("run_id", F.col("tail").alias("log_excerpt"))
    ev = F.struct("recency", "path", "action", "size", "updated_at")
    newest = recent_file_events(events).groupBy("run_id").agg(F.array_sort(F.collect_list(ev)).alias("recent_file_events"))
    n_logs = files.where(is_log(F.col("path"))).groupBy("run_id").agg(F.count("*").alias("n_logs"), F.sum("size").alias("log_bytes"))
    out = status.join(texts, "run_id", "left").join(newest, "run_id", "left").join(n_logs, "run_id", "left")
    return out.withColumns(
        {
            "status_label": status_label(F.col("status")),
            "log_excerpt": F.coalesce("log_excerpt", F.lit("")),
            "n_logs": F.coalesce("n_logs", F.lit(0)),
            "log_bytes": F.coalesce("log_bytes", F.lit(0)),
        }
    )


def log_sources(files: DataFrame) -> DataFrame:
    """Followed logs of each run: key, label and size."""
    return files.where(is_log(F.col("path"))).select("run_id", F.col("path").alias("key"), log_label(F.col("path")).alias("label"), "size")


# --- log lines --------------------------------------------------------------


def byte_offsets(lines: DataFrame) -> DataFrame:
    """Add ``start`` and ``end`` byte offsets of each line, newline included."""
    n = F.octet_length("line") + 1
    return running(lines, ["run_id", "source"], "pos", sums={"end": n}).withColumn("start", F.col("end") - n)


def page_windows(sizes: DataFrame, size: int, before: DataFrame | None = None) -> DataFrame:
    """Byte window ``_a`` to ``_e`` of one page per log, ending at ``before(run_id, source, before)`` or at the end."""
    if before is None:
        wanted = sizes.withColumn("_e", F.col("file_size"))
    else:
        wanted = sizes.join(before, ["run_id", "source"], "left").withColumn("_e", F.greatest(F.lit(0), F.least(F.coalesce("before", "file_size"), "file_size"))).drop("before")
    return wanted.withColumn("_a", F.greatest(F.lit(0), F.col("_e") - max(1, size)))


def cut_pages(spans: DataFrame, wanted: DataFrame) -> DataFrame:
    """Page texts from lines with their byte ``start`` and ``end``; ``wanted`` from :func:`page_windows`."""
    keys = ["run_id", "source"]
    inside = spans.join(wanted, keys).where((F.col("end") > F.col("_a")) & (F.col("start") < F.col("_e")))
    # a newline inside the window ends a line at or before the window's end
    breaks = inside.where((F.col("end") > F.col("_a")) & (F.col("end") <= F.col("_e"))).groupBy(*keys).agg(F.min("end").alias("_nl"))
    at = inside.join(breaks, keys, "left").withColumn("_from", F.when(F.col("_a") > 0, F.coalesce("_nl", "_a")).otherwise(0))
    raw = F.concat("line", F.lit("\n")).cast("binary")
    lo = F.greatest(F.lit(0), F.col("_from") - F.col("start"))
    hi = F.least(F.col("end"), F.col("_e")) - F.col("start")
    piece = F.substring(raw, (lo + 1).cast("int"), (hi - lo).cast("int"))
    cut = at.where(F.col("end") > F.col("_from")).select(*keys, "pos", piece.alias("piece"))
    parts = F.array_sort(F.collect_list(F.struct("pos", F.hex("piece").alias("h"))))
    texts = cut.groupBy(*keys).agg(F.make_valid_utf8(F.unhex(F.array_join(F.transform(parts, lambda p: p["h"]), "")).cast("string")).alias("text"))
    edges = at.groupBy(*keys).agg(F.min("_from").alias("start_offset"))
    out = wanted.join(edges, keys, "left").join(texts, keys, "left")
    start = F.coalesce("start_offset", F.col("_a"))
    return out.select(
        *keys, log_label(F.col("source")).alias("label"), "file_size", start.alias("start_offset"), F.col("_e").alias("end_offset"), (start > 0).alias("has_more"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def log_pages(lines: DataFrame, size: int = PAGE_BYTES, before: DataFrame | None = None) -> DataFrame:
    """One page of text per log, ending at ``before(run_id, source, before)`` or at the end.

    The page starts after the first newline of its byte window, except at the start of
    the file; a window without a newline keeps its partial line. Bytes of a character that
    the window cuts become the replacement character. A page is at most
    ``size`` bytes, which bounds the collect. For logs that are paged more than once,
    :mod:`rolloom.operators.logstore` stores the offsets.
    """
    spans = byte_offsets(lines)
    return cut_pages(spans, page_windows(spans.groupBy("run_id", "source").agg(F.max("end").alias("file_size")), size, before))


def block_kind(line: Column) -> Column:
    """Kind announced by a line, or the empty string."""
    out = F.lit("")
    for kind, marks in reversed(KIND_MARKERS.items()):
        out = F.when(_has_any(line, marks), kind).otherwise(out)
    return out


def classify_lines(lines: DataFrame) -> DataFrame:
    """Add ``kind``, the inherited ``block`` kind and the display ``classes`` of each line."""
    dated = F.col("line").rlike(DATED)
    tagged = lines.withColumn("kind", block_kind(F.col("line")))
    state = F.when(F.col("kind") != "", F.col("kind")).when(dated, "")
    seen = running(tagged, ["run_id", "source"], "pos", lasts={"_state": state})
    inherited = F.when(dated | (F.col("kind") != ""), "").otherwise(F.coalesce("_state", F.lit("")))
    line = F.col("line")
    levels = [F.when(line.contains(f"| {lv}"), f"level-{lv.lower()}") for lv in LEVEL_CLASSES]
    names = [F.when(_has_any(line, marks), f"name-{n}") for n, marks in NAME_CLASSES.items()]
    kinds = (
        F.when(F.col("kind") != "", F.concat(F.lit("kind-"), "kind", F.lit(" kind-header")))
        .when(F.col("block") != "", F.concat(F.lit("kind-"), "block", F.lit(" kind-body")))
        .when(dated, "kind-system")
    )
    return seen.withColumn("block", inherited).withColumn("classes", F.concat_ws(" ", F.lit("log-line"), *levels, *names, kinds)).drop("_state")


def parse_run_log(lines: DataFrame, min_level: str = "TRACE") -> DataFrame:
    """Log records: dated header fields plus the number of continuation lines.

    Lines before the first header belong to no record. ``record_lines`` has the texts.
    """
    heads = _record_lines(lines)
    head = F.col("_is_head")
    recs = heads.groupBy("run_id", "source", "record_id").agg(
        *[F.max(F.when(head, F.col(c))).alias(c) for c in ("time", "name", "level")], F.count("*").alias("n_lines")
    )
    rank = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    return recs.where(F.coalesce(rank[F.col("level")], F.lit(0)) >= LEVELS[min_level])


def _record_lines(lines: DataFrame) -> DataFrame:
    heads = lines.withColumn("_is_head", F.col("line").rlike(HEADER))
    at = running(
        heads,
        ["run_id", "source"],
        "pos",
        sums={"record_id": F.col("_is_head").cast("int")},
        lasts={"_head_pos": F.when(F.col("_is_head"), F.col("pos"))},
    )

    def field(i: int) -> Column:
        return F.when(F.col("_is_head"), F.trim(F.regexp_extract("line", HEADER, i)))

    return at.where(F.col("record_id") > 0).withColumns({"time": field(1), "name": field(2), "level": field(3)})


def record_lines(lines: DataFrame) -> DataFrame:
    """Message lines of each record, numbered from 1: one row per line, however long a record is."""
    r = _record_lines(lines)
    msg = F.when(F.col("_is_head"), F.regexp_extract("line", HEADER, 4)).otherwise(F.col("line"))
    return r.select("run_id", "source", "record_id", (F.col("pos") - F.col("_head_pos") + 1).alias("line_no"), msg.alias("line"))

