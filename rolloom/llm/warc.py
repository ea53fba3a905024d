"""Web archives with dictionary-compressed records: a writer and a reader.

Every page becomes a WARC 1.1 record, compressed as a Zstandard frame of its own; each
archive opens with a skippable frame that holds the dictionary its records are compressed
with, so any record can be read alone, and readers that know only Zstandard skip the frame.
The dictionary of an archive is built from the archive's first ``SAMPLE_BYTES`` of records
(rows come in hash order); too few records to build one from give an archive without.

Of pages with equal payloads of at least ``LEAST_BYTES`` the one with the smallest key is a
``response``, the others are ``revisit`` records that name it and carry no payload; keys that
are null come last, and of rows with equal keys one is the response. Shorter payloads are
responses each. Payloads met very often are matched by a broadcast of bounded size, the rest
by a shuffle.

A task keeps one archive open and streams records into it, so memory is bounded by the sample
or the longest record. Files carry names of their own attempt and count only when the task's
rows are in the manifest, a table written by Spark: attempts that fail, run twice, or are lost
with their executor leave files that no reader opens. The manifest cuts archives into ranges
of whole records, which are read apart.

Null payloads are empty; null or empty urls leave their field out; control characters in urls
are percent-encoded. An empty table gives no archive.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom.llm.skew import join_counted
from rolloom.session import checkpointed, work_path
from rolloom.sources.store import open_store, qualified

#: Payloads from this many bytes on are compared.
LEAST_BYTES = 100
#: Compressed bytes of an archive, and of a range that one task reads.
ARCHIVE_BYTES = 1 << 30
RANGE_BYTES = 64 << 20
#: Bytes of records a dictionary is built from, and its largest size.
SAMPLE_BYTES = 8 << 20
DICTIONARY_BYTES = 110 << 10
LEVEL = 3
#: Payloads whose pages are not shuffled: those met most often, at most as many. Their table is broadcast, about 120 bytes each.
HOT_PAYLOADS = 1 << 17

#: Fixed values of the formats: magic numbers of a dictionary's skippable frame and of a frame, and the revisit profile.
SKIPPABLE = bytes.fromhex("5d2a4d18")
FRAME = bytes.fromhex("28b52ffd")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, start long, stop long, records long"
RECORD = "record_id string, record_type string, date string, url string, page string, payload_bytes long, payload_digest string, refers_to_record string, refers_to string, intact boolean, payload binary"

_CHUNK = 1 << 16
_BATCH_BYTES = 4 << 20
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def decided(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """One row per page with its payload's size and digest, and the row and key of the response it repeats.

    Columns ``row`` (unique), ``page``, ``url``, ``payload`` (null for revisits), ``n_bytes``,
    ``digest``, ``first_row``, ``first_page`` (null for responses).
    """
    raw = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("page"), F.col(url).cast("string").alias("url"), raw.alias("payload"))
    rows = rows.withColumns({"n_bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    path = work_path(pages.sparkSession, "pages")
    rows.write.option("compression", "zstd").parquet(path)
    rows = pages.sparkSession.read.schema(rows.schema).parquet(path)
    long = F.col("n_bytes") >= least_bytes
    place = F.struct(F.col("page").isNull().alias("nil"), "page", "row")
    first = rows.where(long).groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    held = join_counted(rows.where(long), checkpointed(first, "payloads"), "digest", "n", HOT_PAYLOADS)
    again = F.col("row") != F.col("first.row")
    held = held.select("row", "page", "url", F.when(~again, F.col("payload")).alias("payload"), "n_bytes", "digest", F.when(again, F.col("first.row")).alias("first_row"), F.when(again, F.col("first.page")).alias("first_page"))
    none = [F.lit(None).cast(held.schema[c].dataType).alias(c) for c in ("first_row", "first_page")]
    return held.unionByName(rows.where(~long).select("row", "page", "url", "payload", "n_bytes", "digest", *none))


def record(run: uuid.UUID, date: str, row: int, page: str | None, url: str | None, payload: bytes | None, n_bytes: int, digest: str, first_row: int | None, first_page: str | None) -> bytes:
    """Bytes of one WARC record."""
    again = first_row is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if again else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(run, str(row))}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if url:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if page is not None:
        head.append(f"Page-Id: {page}")
    if again:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(run, str(first_row))}>"]
        if first_page is not None:
            head.append(f"Refers-To-Page-Id: {first_page}")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode() + (b"" if again else payload)
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(lines: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    split = (line.partition(":") for line in lines.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in split}


def parsed(raw: bytes) -> tuple:
    """Fields of one record, in the order of ``RECORD``; a damaged record is told as not ``intact``.

    The payload's size and digest are taken from the payload itself; a revisit has none, so
    they are those its headers state.
    """
    head, _, rest = raw.partition(b"\r\n\r\n")
    told = _fields(head)
    kind = told.get("warc-type")
    size = told.get("content-length", "")
    block = rest[: int(size)] if size.isdecimal() else rest
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = _fields(http).get("content-length", "")
    digest = told.get("warc-payload-digest", "").removeprefix("sha256:")
    whole = size.isdecimal() and rest[int(size) :] == b"\r\n\r\n" and stated.isdecimal()
    if kind == "revisit":
        own, n, payload = digest, int(stated) if stated.isdecimal() else None, None
    else:
        own, n = hashlib.sha256(payload).hexdigest(), len(payload)
        whole = whole and own == digest and stated == str(n)
    name = lambda f: told[f].strip("<>") if f in told else None
    return name("warc-record-id"), kind, told.get("warc-date"), told.get("warc-target-uri"), told.get("page-id"), n, own, name("warc-refers-to"), told.get("refers-to-page-id"), whole, payload


def trained(records: list[bytes], most: int = DICTIONARY_BYTES):
    """A Zstandard dictionary of records, or None when there are too few."""
    import zstandard

    pieces = [r[i : i + _CHUNK] for r in records for i in range(0, len(r), _CHUNK)]
    try:
        return zstandard.train_dictionary(min(most, max(256, sum(map(len, pieces)) // 8)), pieces, k=256, d=8)
    except zstandard.ZstdError:
        return None


@dataclass
class Archive:
    """An archive that is being written."""

    path: str
    first: list[bytes]
    level: int
    range_bytes: int
    size: int = 0
    ranges: list[list] = field(default_factory=list)

    def __post_init__(self):
        import zstandard

        store, inner = open_store(self.path)
        self.out = store.open_output_stream(inner, compression=None)  # frames are made here
        dictionary = trained(self.first)
        if dictionary:
            raw = dictionary.as_bytes()
            self.size = self.out.write(SKIPPABLE + len(raw).to_bytes(4, "little") + raw)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=dictionary)
        for r in self.first:
            self.add(r)
        self.first = []

    def add(self, raw: bytes) -> None:
        if not self.ranges or self.ranges[-1][1] - self.ranges[-1][0] >= self.range_bytes:
            self.ranges.append([self.size, self.size, 0])
        self.size += self.out.write(self.compressor.compress(raw))
        self.ranges[-1][1] = self.size
        self.ranges[-1][2] += 1

    def close(self) -> pa.RecordBatch:
        """Rows of the manifest."""
        self.out.close()
        start, stop, records = zip(*self.ranges, strict=True)
        return pa.RecordBatch.from_pydict({"path": [self.path] * len(start), "start": start, "stop": stop, "records": records})


def write(
    pages: DataFrame,
    folder: str,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    date: datetime.datetime | None = None,
    archive_bytes: int = ARCHIVE_BYTES,
    range_bytes: int = RANGE_BYTES,
    sample_bytes: int = SAMPLE_BYTES,
    level: int = LEVEL,
    least_bytes: int = LEAST_BYTES,
) -> DataFrame:
    """Write pages as archives below a new folder, which all executors share; returns its manifest."""
    spark = pages.sparkSession
    folder, run = qualified(spark, folder).rstrip("/"), uuid.uuid4()
    stamp = (date or datetime.datetime.now(datetime.UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)

    def task(batches: Iterator[pa.RecordBatch]):
        attempt, n = uuid.uuid4().hex, 0
        archive, waiting, size = None, [], 0

        def opened(first):
            return Archive(f"{folder}/{attempt}-{n:05d}.warc.zst", first, level, range_bytes)

        for batch in batches:
            for i in range(batch.num_rows):
                raw = record(run, stamp, *(c[i].as_py() for c in batch.columns))
                if archive:
                    archive.add(raw)
                else:
                    waiting.append(raw)
                    size += len(raw)
                    if size >= sample_bytes:
                        archive, waiting, size = opened(waiting), [], 0
                if archive and archive.size >= archive_bytes:
                    yield archive.close()
                    archive, n = None, n + 1
        if waiting:
            archive = opened(waiting)
        if archive:
            yield archive.close()

    rows = decided(pages, key, url, html, least_bytes)
    named = rows.select("row", F.col("page").cast("string"), "url", "payload", "n_bytes", "digest", "first_row", F.col("first_page").cast("string"))
    named.mapInArrow(task, MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Ranges of the archives that were written to a folder."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def archive_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Archives without a manifest, each as one range."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "length")
    return files.select("path", F.lit(0).cast("long").alias("start"), F.col("length").alias("stop"), F.lit(None).cast("long").alias("records"))


def frames(stream, stop: int, dictionary) -> Iterator[bytes]:
    """Contents of the frames from where a stream stands to ``stop``."""
    import zstandard

    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    parts, own = [], decompressor.decompressobj()
    while stream.tell() < stop and (chunk := stream.read(min(_CHUNK, stop - stream.tell()))):
        while chunk:
            parts.append(own.decompress(chunk))
            chunk = b""
            if own.eof:
                yield b"".join(parts)
                chunk = own.unused_data
                parts, own = [], decompressor.decompressobj()
    if parts:
        raise ValueError("an archive ends inside a record")


def dictionary_of(stream):
    """The dictionary at the head of an archive, stored as it is or compressed, and where records begin."""
    import zstandard

    head = stream.read(8)
    if head[:4] != SKIPPABLE:
        return None, 0
    raw = stream.read(int.from_bytes(head[4:], "little"))
    at = 8 + len(raw)
    if raw[:4] == FRAME:
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    return zstandard.ZstdCompressionDict(raw), at


def read(ranges: DataFrame, payload: bool = True) -> DataFrame:
    """Records of the ranges of a manifest, columns as in ``RECORD``; without ``payload`` that column is null."""

    def task(batches: Iterator[pa.RecordBatch]):
        schema = pa.schema([(n, {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (c.split(" ") for c in RECORD.split(", "))])

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for path, start, stop in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                store, inner = open_store(path)
                rows, size = [], 0
                with store.open_input_file(inner) as stream:
                    dictionary, begin = dictionary_of(stream)
                    stream.seek(max(start, begin))
                    for raw in frames(stream, stop, dictionary):
                        row = parsed(raw)
                        rows.append(row if payload else (*row[:-1], None))
                        size += len(raw) if payload else 500
                        if size >= _BATCH_BYTES:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    spread = ranges.select("path", "start", "stop").repartition(max(1, ranges.count()))
    return spread.mapInArrow(task, RECORD)


def round_trip(pages: DataFrame, key: str = "page_id", **options) -> DataFrame:
    """Archive pages in the shared folder and read the archives back; ``page`` and ``refers_to`` get the key's type."""
    found = read(write(pages, work_path(pages.sparkSession, "warc"), key, **options), payload=False)
    kind = pages.schema[key].dataType
    return found.drop("payload").withColumns({c: F.col(c).cast(kind) for c in ("page", "refers_to")}).withColumnRenamed("page", key)
