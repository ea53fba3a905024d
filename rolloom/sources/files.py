"""Readers for task files, passages, run directories, trajectories and feeds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolloom.sources.json_array import RANGE_BYTES, array_elements
from rolloom.sources.store import open_store, qualified

TRAJECTORY_SCHEMA = (
    "trajectory array<struct<step_idx int, response string, thought string, action string, observation string, "
    "execution_time double, done boolean, exit_reason string>>, execution_time double, "
    "messages array<struct<role string, content string>>, metrics map<string,double>"
)
PASSAGE_SCHEMA = "id string, url string, title string, text string"
ATOM_SCHEMA = (
    "title string, summary string, published string, updated string, id string, "
    "author array<struct<name string>>, link array<struct<_title string, _href string>>"
)


def _first_character(spark: SparkSession, path: str) -> str:
    """First character of the files of a path that is not blank; empty if there is none."""
    for row in spark.read.format("binaryFile").load(path).where("length > 0").select("path").orderBy("path").limit(1).collect():
        store, inner = open_store(row["path"])
        with store.open_input_stream(inner) as stream:
            while part := stream.read(4096):
                if part.strip(b" \t\r\n\xef\xbb\xbf"):
                    return part.strip(b" \t\r\n\xef\xbb\xbf")[:1].decode("utf-8", "replace")
    return ""


def read_tasks(spark: SparkSession, path: str, schema: str | T.StructType, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Tasks stored as JSON arrays or as JSON lines, told apart by the first non-blank character.

    An array is read by as many tasks as it has byte ranges. Stores that pyarrow cannot open
    are left to Spark's own reader, which takes an array file as one task.
    """
    try:
        is_array = _first_character(spark, path) == "["
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
        return spark.read.schema(schema).json(path, multiLine=bool(head) and head[0][0].lstrip().startswith("["))
    if not is_array:
        return spark.read.schema(schema).json(path)
    return array_elements(spark, path, range_bytes).select(F.from_json("text", schema).alias("task")).select("task.*")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Prepared samples."""
    return spark.read.parquet(path)


def read_passages(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Passage Parquet files; unreadable files are skipped."""
    reader = spark.read.option("ignoreCorruptFiles", True)
    return (reader.schema(schema) if schema else reader).parquet(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines corpus; the stored id replaces line numbers."""
    return spark.read.schema(PASSAGE_SCHEMA).json(path)


def scan_runs(spark: SparkSession, root: str) -> DataFrame:
    """Files below each run directory: ``run_id, path, size, mtime``.

    One task lists the root, and its directories are dealt to tasks that list one run after
    the other: no list of runs or files comes to the driver. A run directory without files
    appears with a null path. Stores that pyarrow cannot open are listed by Spark's reader.
    """
    root = qualified(spark, root).rstrip("/")
    try:
        open_store(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return _scan_by_reader(spark, root)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            store, base = open_store(root)
            found = store.get_file_info(fs.FileSelector(base))
            yield pa.RecordBatch.from_pydict({"run_id": pa.array([i.base_name for i in found if i.type == fs.FileType.Directory], pa.string())})

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(root)
        for batch in batches:
            for run in batch.column(0).to_pylist():
                inside = f"{base}/{run}"
                found = [i for i in store.get_file_info(fs.FileSelector(inside, recursive=True)) if i.type == fs.FileType.File]
                rows = [(i.path[len(inside) + 1 :], i.size, i.mtime) for i in found] or [(None, None, None)]
                path, size, mtime = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([run] * len(rows)), pa.array(path, pa.string()), pa.array(size, pa.int64()), pa.array(mtime, pa.timestamp("us", "UTC"))], ["run_id", "path", "size", "mtime"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = spark.range(1, numPartitions=1).mapInArrow(runs, "run_id string").repartition(n)
    return named.mapInArrow(files, "run_id string, path string, size long, mtime timestamp")


def _scan_by_reader(spark: SparkSession, root: str) -> DataFrame:
    """The same by Spark's file listing; the content column is pruned."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select(F.split_part("path", F.lit(root.split("://")[-1] + "/"), F.lit(2)).alias("rel"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
        .where(F.col("rel").contains("/"))
        .select(F.split_part("rel", F.lit("/"), F.lit(1)).alias("run_id"), F.expr("substr(rel, locate('/', rel) + 1)").alias("path"), "size", "mtime")
    )
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(root)
    statuses = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = [(s.getPath().getName(),) for s in statuses if s.isDirectory()]
    return spark.createDataFrame(names, "run_id string").join(files, "run_id", "left")


def read_trajectories(spark: SparkSession, root: str) -> DataFrame:
    """Steps of every ``<run_id>/interaction_result.json`` below a root; ``ord`` is the list position."""
    raw = spark.read.schema(TRAJECTORY_SCHEMA).json(f"{root.rstrip('/')}/*/interaction_result.json", multiLine=True)
    run_id = F.element_at(F.split(F.input_file_name(), "/"), -2)
    return raw.select(F.url_decode(run_id).alias("run_id"), F.posexplode("trajectory").alias("ord", "step")).select("run_id", "ord", "step.*")


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom feed documents."""
    return spark.read.format("xml").option("rowTag", "entry").schema(ATOM_SCHEMA).load(path)
