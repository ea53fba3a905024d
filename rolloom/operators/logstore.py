"""Stored logs and two indexes over them: byte offsets per block of lines, and n-gram postings.

Lines are stored in folders by a hash of their log and place, in order inside. The offset
index has one row per block of lines; a page reads the blocks it shows. The search index lists,
per scope, which runs hold which piece of one to three characters; a word's runs are those
that hold all its pieces, and only their names, files and lines are tested for the word itself.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from rolloom.functions.jsonv import let
from rolloom.operators import monitor
from rolloom.operators.ordered import running
from rolloom.session import checkpointed

#: Lines per block, blocks of one log that share a folder, and folders.
BLOCK_LINES, SEGMENT_BLOCKS, PARTS = 1024, 4096, 64
#: Characters of a piece.
GRAM = 3
#: Values that a filter names one by one; more of them are joined.
MOST_NAMED = 1000

_LOG = ["run_id", "source"]
SCOPES = ("run_id", "status", "files", "logs")
LINES = "run_id string, source string, block long, pos long, line string, part int"
FILES, LOGS = "run_id string, path string, part int", "run_id string, pos long, text string, part int"
POSTINGS = "scope string, run_id string, piece string, part int"


def _part(parts: int, *columns) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(parts)).cast("int")


def _sorted_into(df: DataFrame, path: str, *order: str) -> None:
    """Write rows to one folder per part, in order and in files of even size."""
    ranged = df.repartitionByRange("part", *order).sortWithinPartitions("part", *order)
    ranged.write.mode("overwrite").partitionBy("part").parquet(path)


def _named(df: DataFrame, column: str) -> list | None:
    """Different values of a column, or None when there are too many to name."""
    found = df.select(column).distinct().limit(MOST_NAMED + 1).collect()
    return None if len(found) > MOST_NAMED else [r[0] for r in found]


def _stored(spark: SparkSession, path: str, schema: str | StructType, wanted: DataFrame, *named: str) -> DataFrame:
    """Rows of a stored table in the folders of ``wanted``, narrowed by its values of some columns."""
    folders = [r[0] for r in wanted.select("part").distinct().collect()]  # at most one per folder
    rows = spark.read.schema(schema).parquet(path).where(F.col("part").isin(folders))
    for c in named:
        values = _named(wanted, c)
        if values is not None:
            rows = rows.where(F.col(c).isin(values))
    return rows


# --- pages ------------------------------------------------------------------


def write_lines(lines: DataFrame, path: str, block_lines: int = BLOCK_LINES, parts: int = PARTS, segment_blocks: int = SEGMENT_BLOCKS) -> None:
    """Store ``lines(run_id, source, pos, line)`` and the offsets of their blocks."""
    block = F.floor((F.col("pos") - 1) / block_lines)
    placed = lines.select(*_LOG, block.alias("block"), "pos", "line")
    placed = placed.withColumn("part", _part(parts, *_LOG, F.floor(F.col("block") / segment_blocks)))
    _sorted_into(placed, f"{path}/lines", *_LOG, "block", "pos")
    size = F.sum(F.octet_length("line") + 1)
    blocks = placed.groupBy(*_LOG, "block", "part").agg(F.min("pos").alias("first_line"), F.count("*").alias("n_lines"), size.alias("_size"))
    ends = running(blocks, _LOG, "block", sums={"end": F.col("_size")})
    ends.withColumn("start", F.col("end") - F.col("_size")).drop("_size").write.mode("overwrite").parquet(f"{path}/blocks")


def pages(spark: SparkSession, path: str, size: int = monitor.PAGE_BYTES, before: DataFrame | None = None) -> DataFrame:
    """Pages as :func:`monitor.log_pages` gives them, from the blocks that they show.

    With ``before(run_id, source, before)`` only the logs named there have a page.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    if before is not None:
        blocks = blocks.join(before.select(*_LOG), _LOG, "left_semi")
    wanted = monitor.page_windows(blocks.groupBy(*_LOG).agg(F.max("end").alias("file_size")), size, before)
    shown = blocks.join(wanted, _LOG).where((F.col("end") > F.col("_a")) & (F.col("start") < F.col("_e")))
    shown = checkpointed(shown.select(*_LOG, "block", "part", F.col("start").alias("_start")), "blocks")
    lines = _stored(spark, f"{path}/lines", LINES, shown, "run_id", "block").join(shown, [*_LOG, "block", "part"])
    # at most the lines of a block
    before_it = W.partitionBy(*_LOG, "block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    n = F.octet_length("line") + 1
    spans = lines.withColumn("end", F.col("_start") + F.sum(n).over(before_it)).withColumn("start", F.col("end") - n)
    return monitor.cut_pages(spans.select(*_LOG, "pos", "line", "start", "end"), wanted)


# --- search -----------------------------------------------------------------


def pieces(c: Column) -> Column:
    """Different pieces of one to ``GRAM`` characters of a lower-cased text."""

    def of(low: Column, n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda i: F.substring(low, i, F.lit(n)))
        return F.when(F.length(low) >= n, every).otherwise(F.array().cast("array<string>"))

    # bound once: a text lowered inside the inner functions would be lowered for every piece
    return let(F.lower(c), lambda low: F.array_distinct(F.concat(*[of(low, n) for n in range(1, GRAM + 1)])))


def pieces_of_word(word: str) -> list[str]:
    """Pieces that a text must hold to hold the word: the word itself if it is short."""
    if len(word) <= GRAM:
        return [word]
    return sorted({word[i : i + GRAM] for i in range(len(word) - GRAM + 1)})


def write_search_index(status: DataFrame, files: DataFrame, tail: DataFrame, path: str, parts: int = PARTS) -> None:
    """Store runs, files and tail lines by run, and the postings of their pieces.

    ``status`` as from :func:`monitor.run_status`, ``files(run_id, path)``, ``tail(run_id, source, pos, text)``.
    Each is worked out once: postings are made from the stored tables. The pieces of a run's
    tail, which is bounded, meet where its lines are, and only different ones are shuffled.
    """
    spark, here = status.sparkSession, _part(parts, "run_id")
    held = checkpointed(status, "runs").withColumn("part", here)
    spark.createDataFrame([(parts, held.schema.json())], "parts int, runs string").write.mode("overwrite").parquet(f"{path}/layout")
    logs = checkpointed(tail.where(F.col("source") == monitor.RUN_LOG).select("run_id", "pos", "text"), "tails").withColumn("part", here)
    named = checkpointed(files.select("run_id", "path"), "files").withColumn("part", here)
    _sorted_into(held, f"{path}/runs", "run_id")
    _sorted_into(named, f"{path}/files", "run_id")
    _sorted_into(logs, f"{path}/logs", "run_id", "pos")
    label = monitor.status_label(F.col("status"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = {
        "run_id": held.select("run_id", F.col("run_id").alias("t")).repartition(n, "run_id"),
        "status": held.repartition(n, "run_id").select("run_id", F.explode(F.array("status", label)).alias("t")),
        "files": named.select("run_id", F.col("path").alias("t")).repartition(n, "run_id", "t").distinct(),
        "logs": logs.select("run_id", F.col("text").alias("t")).repartition(n, "run_id"),
    }
    posted = [d.select(F.lit(s).alias("scope"), "run_id", F.explode(pieces(F.col("t"))).alias("piece")).distinct() for s, d in texts.items()]
    every = checkpointed(posted[0].union(posted[1]).union(posted[2]).union(posted[3]), "pieces")
    _sorted_into(every.withColumn("part", _part(parts, "piece")), f"{path}/postings", "piece", "scope", "run_id")


def _layout(spark: SparkSession, path: str) -> tuple[int, StructType]:
    """Number of folders, and columns of the stored runs."""
    row = spark.read.schema("parts int, runs string").parquet(f"{path}/layout").first()
    return row["parts"], StructType.fromJson(json.loads(row["runs"]))


def candidates(spark: SparkSession, path: str, words: list[str], scopes: list[str]) -> DataFrame:
    """``scope, word, run_id``: runs that hold all pieces of a word within a scope; ``word`` is its number."""
    asked = [(i, p) for i, w in enumerate(words) for p in pieces_of_word(w)]
    sizes = {i: len(pieces_of_word(w)) for i, w in enumerate(words)}
    by_piece: dict[str, list[int]] = {}
    for i, p in asked:
        by_piece.setdefault(p, []).append(i)
    parts = spark.createDataFrame([(p,) for p in by_piece], "piece string")
    posted = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    n_parts, _ = _layout(spark, path)
    folders = [r[0] for r in parts.select(_part(n_parts, "piece")).distinct().collect()]
    named = F.create_map(*[x for p, ws in by_piece.items() for x in (F.lit(p), F.array(*[F.lit(w) for w in ws]))])
    needed = F.create_map(*[x for i, n in sizes.items() for x in (F.lit(i), F.lit(n))])
    held = posted.where(F.col("part").isin(folders) & F.col("piece").isin(list(by_piece)) & F.col("scope").isin(scopes))
    each = held.select("scope", "run_id", F.explode(named[F.col("piece")]).alias("word"))
    return each.groupBy("scope", "word", "run_id").agg(F.count("*").alias("_n")).where(F.col("_n") == needed[F.col("word")]).drop("_n")


def search(spark: SparkSession, path: str, text: str, mode: str = "all", status: str = "all") -> DataFrame:
    """Runs as :func:`monitor.search_runs` finds them, through the postings."""
    words = text.lower().split()
    n_parts, schema = _layout(spark, path)
    if not words:
        return monitor.filter_runs(spark.read.schema(schema).parquet(f"{path}/runs").drop("part"), status=status)
    scopes = list(SCOPES) if mode == "all" else [mode] if mode in SCOPES else []
    likely = checkpointed(candidates(spark, path, words, scopes).withColumn("part", _part(n_parts, "run_id")), "candidates")
    runs = _stored(spark, f"{path}/runs", schema, likely, "run_id").drop("part")
    sides = {
        "run_id": lambda: runs.select("run_id", F.col("run_id").alias("t")),
        "status": lambda: runs.select("run_id", F.explode(F.array("status", monitor.status_label(F.col("status")))).alias("t")),
        "files": lambda: _stored(spark, f"{path}/files", FILES, likely.where("scope = 'files'"), "run_id").select("run_id", F.col("path").alias("t")),
        "logs": lambda: _stored(spark, f"{path}/logs", LOGS, likely.where("scope = 'logs'"), "run_id").select("run_id", F.col("text").alias("t")),
    }
    found = None
    for scope in scopes:
        mine = likely.where(F.col("scope") == scope).groupBy("run_id").agg(F.collect_set("word").alias("_words"))  # at most the words asked for
        side = sides[scope]().join(mine, "run_id")
        flags = [F.max(F.array_contains("_words", i) & F.lower("t").contains(w)).alias(f"_w{i}") for i, w in enumerate(words)]
        hits = side.groupBy("run_id").agg(*flags)
        found = hits if found is None else found.union(hits)
    if found is None:
        return runs.limit(0)
    sums = found.groupBy("run_id").agg(*[F.max(f"_w{i}").alias(f"_w{i}") for i in range(len(words))])
    for i in range(len(words)):
        sums = sums.where(f"_w{i}")
    return monitor.filter_runs(runs, status=status).join(sums.select("run_id"), "run_id", "left_semi")
