"""Streaming source that follows run directories: growing logs and other files.

Spark's file source reads a file once; a log grows. Directories are listed in tasks, each of
which has the runs whose name's hash falls in its share, and compares what it finds with the
share's table of the version before. The new table is written to the offset folder before the
changes are told, so a batch that is run again tells the same ones; the offset itself is the
number of the version. Changes name byte ranges; :func:`read_text` reads their bytes in a step
of its own, dealt anew, so that a log that grew by gigabytes is read by many tasks.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.feather as feather
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from rolloom.operators import monitor
from rolloom.sources.store import open_store

CHANGES = (
    "run_id string, path string, kind string, action string, start bigint, end bigint, "
    "range_end bigint, updated_at double"
)
SCHEMA = f"{CHANGES}, text string"
#: Bytes of one range; a log that grew more becomes several.
RANGE_BYTES = 8 * 1024 * 1024
#: Parts in which the runs are listed, unless the reader is told another number.
SHARES = 8


def follows(path: str) -> bool:
    """Whether a file is read as a log; otherwise only its changes are told."""
    return re.match(monitor.LOG_NAME, path) is not None


@dataclass
class Share(InputPartition):
    """The runs that one task lists, and the versions between which it tells changes."""

    number: int
    of: int
    start: int
    end: int

    def __post_init__(self):
        super().__init__(self.number)


def _aligned(data: bytes, lead: int, is_last: bool, size: int) -> bytes:
    """Cut a range at character borders: skip a started character, finish the last one."""
    begin = 0
    while lead and begin < min(3, len(data)) and data[begin] & 0xC0 == 0x80:
        begin += 1
    if is_last:
        return data[begin:]
    end = size
    while end < len(data) and data[end] & 0xC0 == 0x80:
        end += 1
    return data[begin:end]


def range_text(root: str, run_id: str, path: str, start: int, end: int, range_end: int) -> str:
    """Text of a byte range of a log, cut at character borders."""
    store, base = open_store(root)
    with store.open_input_file(f"{base}/{run_id}/{path}") as f:
        f.seek(start)
        last = end >= range_end
        data = f.read(end - start + (0 if last else 3))
    return _aligned(data, start, last, end - start).decode("utf-8", errors="replace")


class RunLogReader(DataSourceStreamReader):
    """Offsets are ``{"version": n}``; the files of version ``n`` are tables in ``<offsets>/<n>``, one per share."""

    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.offsets = options.get("offsets", f"{self.root}.offsets").rstrip("/")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.wanted = int(options.get("shares", SHARES))

    def _shares(self) -> int:
        """The number of shares, fixed by the first start."""
        store, base = open_store(self.offsets)
        store.create_dir(base, recursive=True)
        path = f"{base}/shares.json"
        if not store.get_file_info(path).is_file:
            draft = f"{path}-{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as f:
                f.write(json.dumps(self.wanted).encode())
            store.move(draft, path)
        with store.open_input_stream(path) as f:
            return json.loads(f.read())

    def _versions(self) -> list[int]:
        from pyarrow import fs

        store, base = open_store(self.offsets)
        found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return sorted(int(i.base_name) for i in found if i.type == fs.FileType.Directory and i.base_name.isdecimal())

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        """The next version: whether anything changed is found by the tasks that list."""
        return {"version": max(self._versions(), default=0) + 1}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if start["version"] >= end["version"]:
            return []
        n = self._shares()
        return [Share(i, n, start["version"], end["version"]) for i in range(n)]

    def commit(self, end: dict) -> None:
        """Forget versions that no batch can start from any more."""
        store, base = open_store(self.offsets)
        for v in self._versions():
            if v < end["version"] - 1:
                store.delete_dir(f"{base}/{v}")

    def _listed(self, share: Share) -> pa.Table:
        """Runs (paths without a slash) and files of a share, with sizes and times."""
        from pyarrow import fs

        store, base = open_store(self.root)
        found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
        runs = [i.base_name for i in found if zlib.crc32(i.base_name.encode()) % share.of == share.number and i.type == fs.FileType.Directory]
        del found
        rows: list[tuple[str, int, int]] = []
        for run in runs:
            rows.append((run, -1, 0))
            inside = store.get_file_info(fs.FileSelector(f"{base}/{run}", recursive=True, allow_not_found=True))
            rows += [(f"{run}/{i.path[len(base) + len(run) + 2 :]}", i.size, i.mtime_ns) for i in inside if i.type == fs.FileType.File]
        path, size, mtime = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"path": pa.array(path, pa.string()), "size": pa.array(size, pa.int64()), "mtime": pa.array(mtime, pa.int64())})

    def _files(self, share: Share, version: int, make: bool) -> dict[str, tuple[int, int]]:
        """A share's files as of a version; one that is not there yet is made by listing."""
        if not version:
            return {}
        store, base = open_store(self.offsets)
        path = f"{base}/{version}/{share.number}.arrow"
        if make and not store.get_file_info(path).is_file:
            store.create_dir(f"{base}/{version}", recursive=True)
            draft = f"{base}/{version}/.{share.number}-{uuid.uuid4().hex}"
            with store.open_output_stream(draft, compression=None) as f:
                feather.write_feather(self._listed(share), f)
            # of two tries of a task the first table stays
            if store.get_file_info(path).is_file:
                store.delete_file(draft)
            else:
                store.move(draft, path)
        with store.open_input_file(path) as f:
            t = feather.read_table(f)
        return {p: (s, m) for p, s, m in zip(*(c.to_pylist() for c in t.columns), strict=True)}

    def read(self, partition: Share) -> Iterator[tuple]:
        old, new = self._files(partition, partition.start, False), self._files(partition, partition.end, True)
        for name in sorted({*old, *new}):
            yield from self._changes(name, old.get(name), new.get(name))

    def _changes(self, name: str, before: tuple[int, int] | None, now: tuple[int, int] | None) -> Iterator[tuple]:
        run, _, path = name.partition("/")
        if not path:
            if (before is None) != (now is None):
                yield (run, "", "run", "deleted" if now is None else "created", 0, 0, 0, 0.0)
            return
        kind = "log" if follows(path) else "file"
        if now is None:
            yield (run, path, kind, "deleted", 0, 0, 0, 0.0)
            return
        size, at = now[0], now[1] / 1e9
        if kind == "file":
            if before != now:
                yield (run, path, kind, "created" if before is None else "modified", 0, size, size, at)
            return
        begin = before[0] if before and size >= before[0] else 0
        if before is None and not size:
            yield (run, path, kind, "append", 0, 0, 0, at)
        for a in range(begin, size, self.range_bytes):
            yield (run, path, kind, "append", a, min(a + self.range_bytes, size), size, at)


class RunLogSource(DataSource):
    """``spark.readStream.format("run_log_tail").load(root)``: changes, without the text of logs."""

    @classmethod
    def name(cls) -> str:
        return "run_log_tail"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return RunLogReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to a session."""
    spark.dataSource.register(RunLogSource)


def read_text(changes: DataFrame, root: str, tasks: int) -> DataFrame:
    """Add ``text`` to changes: the bytes of appended ranges, read by ``tasks`` tasks that share the ranges evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first, size = [], 0, 0
            rows = zip(*(batch.column(c).to_pylist() for c in ("action", "run_id", "path", "start", "end", "range_end")), strict=True)
            for i, (action, *place, start, end, range_end) in enumerate(rows):
                texts.append(range_text(root, *place, start, end, range_end) if action == "append" and end > start else "")
                size += len(texts[-1])
                if size >= RANGE_BYTES or i == batch.num_rows - 1:
                    part = batch.slice(first, len(texts))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])
                    texts, first, size = [], i + 1, 0

    return changes.repartition(tasks).mapInArrow(run, SCHEMA)
