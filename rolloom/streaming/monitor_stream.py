"""Run monitoring as a stream: tails, status changes, an event log and latest run rows."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rolloom.operators import monitor
from rolloom.sources import tail
from rolloom.sources.store import qualified

def file_changes(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """Stream of log appends and file changes below a root of run directories.

    ``offsets`` names the folder of the file tables, by default beside the root. ``shares``
    is not bound to the shuffle partitions: every share lists the root, so more of them for
    more runs would cost their product.
    """
    tail.register(spark)
    root, tasks = qualified(spark, root), spark.conf.get("spark.sql.shuffle.partitions")
    reader = spark.readStream.format("run_log_tail")
    for k, v in options.items():
        reader = reader.option(k, qualified(spark, v) if k == "offsets" else v)
    return tail.read_text(reader.load(root), root, int(tasks))


def slim(changes: DataFrame, max_chars: int = monitor.MAX_TAIL_CHARS) -> DataFrame:
    """Drop text that cannot reach a tail before rows are shuffled by run.

    Only ranges ending within ``4 * max_chars`` bytes of the file's end can matter, so a
    log that grew by gigabytes sends a run's state at most a few tail-sized rows of text.
    """
    near = F.col("range_end") - F.col("end") < 4 * max_chars
    return changes.withColumn("text", F.when(near, F.right("text", F.lit(max_chars))).otherwise(""))


class RunState(StatefulProcessor):
    """Per run: its facts, how many files it has, the tail of each log and the other files.

    The number of files and the facts follow each change; the maps are asked for single keys
    only, and a removed run's state goes as a whole. Rows tell the facts before and after;
    what status they mean is left to :func:`rolloom.operators.monitor.status_of`.
    """

    def __init__(self, max_chars: int):
        self.max_chars = max_chars

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.facts = handle.getValueState("facts", "updated_at double, file_count bigint, " + ", ".join(f"{f} boolean" for f in FACTS))
        self.tails = handle.getMapState("tails", "path string", "tail string")
        self.files = handle.getMapState("files", "path string", "size bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        (run_id,) = key
        is_new = not self.facts.exists()
        updated, count, *before = (0.0, 0, False, False, False, False) if is_new else self.facts.get()
        has_result, has_log = before[:2]
        changed = removed = False
        appended: dict[str, str] = {}
        touched: list[tuple[str, str]] = []
        # what this batch asked the maps for or changed: every key is fetched once and stored once
        held: dict[str, bool] = {}
        tails: dict[str, str] = {}
        # small per row: slim() bounded the texts, and a file changes once per batch
        for r in sorted(rows, key=lambda r: (r.path, r.start)):
            path = r.path
            updated = max(updated, float(r.updated_at))
            if r.kind == "run":
                removed = r.action == "deleted"
                continue
            here = r.action != "deleted"
            state = self.tails if r.kind == "log" else self.files
            if path not in held:
                held[path] = not is_new and state.containsKey((path,))
            known, held[path] = held[path], here
            count += int(here) - int(known)
            has_result = here if path == monitor.RESULT_FILE else has_result
            has_log = here if path == monitor.RUN_LOG else has_log
            if not here:
                changed = True
                touched.append((path, "deleted"))
                tails.pop(path, None)
                if known:
                    state.removeKey((path,))
            elif r.kind == "log":
                if path not in tails:
                    tails[path] = self.tails.getValue((path,))[0] if known else ""
                tails[path] = (tails[path] + r.text)[-self.max_chars :]
                if r.end > r.start:
                    changed = True
                    appended[path] = (appended.get(path, "") + r.text)[-self.max_chars :]
            else:
                changed = True
                touched.append((path, "modified" if known else "created"))
                self.files.updateValue((path,), (int(r.end),))
        if removed:
            self.tails.clear()
            self.files.clear()
            self.facts.clear()
            nothing = [False] * (2 * len(FACTS))
            yield _STATE_ROW(run_id, "run_removed", None, None, None, None, updated, 0, *nothing, True)
            return
        for path, text in tails.items():
            self.tails.updateValue((path,), (text,))
        log = "" if not has_log else tails[monitor.RUN_LOG] if monitor.RUN_LOG in tails else self.tails.getValue((monitor.RUN_LOG,))[0]
        now = [has_result, has_log, any(m in log for m in monitor.VERIFY_MARKERS), any(m in log for m in monitor.RUNNING_MARKERS)]
        self.facts.update((updated, count, *now))
        rest = (updated, count, *now, *before, changed or is_new)
        # appended text is as bounded as a tail; a batch has one event per log and per changed file
        for path, text in appended.items():
            yield _STATE_ROW(run_id, "log_append", path, None, text, log, *rest)
        for path, action in touched:
            yield _STATE_ROW(run_id, "file_changed", path, action, None, log, *rest)
        yield _STATE_ROW(run_id, "state", None, None, None, log, *rest)

    def close(self) -> None:
        pass


#: What a run's status is told from, as :func:`rolloom.operators.monitor.status_of` takes it.
FACTS = ("has_result", "has_log", "in_verify", "in_running")
_STATE_SCHEMA = (
    "run_id string, event_type string, path string, action string, text string, log string, updated_at double, file_count bigint, "
    + ", ".join(f"{f} boolean" for f in FACTS)
    + ", "
    + ", ".join(f"was_{f} boolean" for f in FACTS)
    + ", fresh boolean"
)
_STATE_ROW = Row(*[c.split(" ")[0] for c in _STATE_SCHEMA.split(", ")])


def run_updates(changes: DataFrame, max_chars: int = monitor.MAX_TAIL_CHARS) -> DataFrame:
    """``log_append``, ``file_changed``, ``status_changed``, ``run_update`` and ``run_removed`` events per run.

    The ``tail`` of a ``log_append`` is what its log gained, up to ``max_chars``.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = slim(changes, max_chars).groupBy("run_id").transformWithState(RunState(max_chars), outputStructType=_STATE_SCHEMA, outputMode="update", timeMode="None")
    status = monitor.status_of(*[F.col(f) for f in FACTS])
    moved = status != monitor.status_of(*[F.col(f"was_{f}") for f in FACTS])
    told = F.filter(F.array(F.when(moved, "status_changed"), F.when(moved | F.col("fresh"), "run_update")), lambda e: e.isNotNull())
    kind, removed = F.col("event_type"), F.col("event_type") == "run_removed"
    return rows.withColumn("events", F.when(kind == "state", told).otherwise(F.array(kind))).select(
        "run_id",
        F.explode("events").alias("event_type"),
        F.when(~removed, status).alias("status"),
        monitor.current_step(F.col("log")).alias("current_step"),
        "file_count",
        F.when(kind == "log_append", F.col("text")).when(kind == "state", F.col("log")).alias("tail"),
        "updated_at",
        "path",
        "action",
    )


#: Parts of the run table; a batch rewrites only the parts whose runs changed.
BUCKETS = 64
#: Manifests that stay readable, and how long a folder of an older one is left to its readers.
KEEP_MANIFESTS, GRACE_SECONDS = 2, 600


def _folder(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _manifests(spark: SparkSession, out: str) -> list[tuple[int, int]]:
    """Batch numbers of the committed manifests and when they were committed, in milliseconds."""
    system, folder = _folder(spark, f"{out}/manifests")
    if not system.exists(folder):
        return []
    named = [(s.getPath().getName(), s.getModificationTime()) for s in system.listStatus(folder)]
    return sorted((int(n.removesuffix(".json")), t) for n, t in named if n.endswith(".json") and not n.startswith("."))


def _manifest(spark: SparkSession, out: str, batch_id: int) -> dict[int, int]:
    """The batch that wrote each bucket's folder, as of a batch."""
    system, path = _folder(spark, f"{out}/manifests/{batch_id}.json")
    stream = system.open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return {int(b): v for b, v in json.loads(text).items()}


def _commit(spark: SparkSession, out: str, batch_id: int, versions: dict[int, int]) -> None:
    """Write a manifest under another name and rename it: readers see all of a batch or nothing."""
    system, draft = _folder(spark, f"{out}/manifests/.{batch_id}-{uuid.uuid4().hex}")
    stream = system.create(draft)
    stream.write(bytearray(json.dumps(versions).encode()))
    stream.close()
    _, path = _folder(spark, f"{out}/manifests/{batch_id}.json")
    if not system.rename(draft, path) and not system.exists(path):
        raise OSError(f"the manifest of batch {batch_id} could not be committed")


def _expire(spark: SparkSession, out: str, keep: int, grace: float) -> None:
    """Delete manifests beyond the newest ``keep`` once they are older than ``grace`` seconds, and folders that only they name."""
    found = _manifests(spark, out)
    old = [b for b, t in found[:-keep] if t < (time.time() - grace) * 1000]
    if not old:
        return
    stay = {(b, v) for batch, _ in found if batch not in old for b, v in _manifest(spark, out, batch).items()}
    for batch in old:
        for b, v in _manifest(spark, out, batch).items():
            if (b, v) not in stay:
                system, folder = _folder(spark, f"{out}/runs/bucket={b}/batch_id={v}")
                system.delete(folder, True)
        system, path = _folder(spark, f"{out}/manifests/{batch}.json")
        system.delete(path, False)


def write_batch(batch: DataFrame, batch_id: int, out: str, keep: int = KEEP_MANIFESTS, grace: float = GRACE_SECONDS) -> None:
    """``foreachBatch`` sink: the event log of this batch and the merged parts of the run table.

    Only buckets with changed runs are read and written, in folders named by the batch. A
    manifest that names every bucket's folder makes the batch visible, all at once; a batch
    that has one is not written again, and one that failed before leaves folders that its next
    try overwrites. Events are ordered by ``(batch_id, seq)``.
    """
    spark = batch.sparkSession
    committed = [b for b, _ in _manifests(spark, out)]
    if committed and committed[-1] >= batch_id:
        return
    versions = _manifest(spark, out, committed[-1]) if committed else {}
    events, runs = f"{out}/events/batch_id={batch_id}", f"{out}/runs"
    batch.withColumn("seq", F.monotonically_increasing_id()).write.mode("overwrite").parquet(events)
    order = F.struct(F.lit(batch_id).cast("bigint").alias("batch_id"), F.col("seq").alias("row"))
    newest = spark.read.parquet(events).where(F.col("event_type").isin("run_update", "run_removed")).drop("path", "action").withColumn("seq", order)
    newest = newest.withColumn("bucket", F.pmod(F.xxhash64("run_id"), F.lit(BUCKETS)).cast("int"))
    touched = [r[0] for r in newest.select("bucket").distinct().collect()]  # at most BUCKETS numbers
    older = [f"{runs}/bucket={b}/batch_id={versions[b]}" for b in touched if b in versions]
    current = spark.read.option("basePath", runs).parquet(*older).drop("batch_id") if older else newest.limit(0)
    if touched:
        merged = monitor.merge_runs(current, newest).withColumn("batch_id", F.lit(batch_id))
        # a bucket is written by one task, as one file
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch_id").parquet(runs)
    _commit(spark, out, batch_id, versions | {b: batch_id for b in touched})
    _expire(spark, out, keep, grace)


def follow(spark: SparkSession, root: str, out: str, checkpoint: str, *, once: bool = True, max_chars: int = monitor.MAX_TAIL_CHARS, interval: str = "1 second", **options: str):
    """Start the monitor stream; ``once`` processes what is there and stops."""
    updates = run_updates(file_changes(spark, root, **{"offsets": f"{checkpoint}-listing", **options}), max_chars)
    writer = updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: write_batch(df, i, out))
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()


def latest_runs(spark: SparkSession, out: str) -> DataFrame:
    """The run table as of the newest batch, from one manifest; removed runs are left out."""
    committed = _manifests(spark, out)
    versions = _manifest(spark, out, committed[-1][0]) if committed else {}
    if not versions:
        raise FileNotFoundError(f"no run table below {out}")
    runs = f"{out}/runs"
    found = spark.read.option("basePath", runs).parquet(*[f"{runs}/bucket={b}/batch_id={v}" for b, v in sorted(versions.items())])
    return found.drop("bucket", "batch_id").where(F.col("event_type") != "run_removed")


def stored_events(spark: SparkSession, out: str) -> DataFrame:
    """Event log of the committed batches, with its ``batch_id`` partition column."""
    committed = _manifests(spark, out)
    return spark.read.parquet(f"{out}/events").where(F.col("batch_id") <= (committed[-1][0] if committed else -1))


def stored_events_after(events: DataFrame, batch_id: int, seq: int) -> DataFrame:
    """Events behind a cursor; whole older batches are pruned by folder."""
    later = (F.col("batch_id") > batch_id) | ((F.col("batch_id") == batch_id) & (F.col("seq") > seq))
    return events.where((F.col("batch_id") >= batch_id) & later)
