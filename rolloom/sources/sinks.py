"""Writers for samples, corpora, indexes and rollouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.session import checkpointed

#: Rows of a cell in one file of the index.
INDEX_FILE_ROWS = 100_000


def write_samples(samples: DataFrame, path: str) -> None:
    """Samples as Parquet, one folder per split when there is a split column."""
    writer = samples.write.mode("overwrite")
    (writer.partitionBy("split") if "split" in samples.columns else writer).parquet(path)


def write_corpus(passages: DataFrame, path: str) -> None:
    """Corpus as JSON lines with the id as text."""
    passages.select(F.col("id").cast("string"), "url", "title", "text").write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_doc_store(passages: DataFrame, url_index: DataFrame, path: str) -> None:
    """Documents and the url index as two tables, the index clustered by url."""
    passages.write.mode("overwrite").parquet(f"{path}/docs")
    url_index.repartitionByRange("url", "pos").sortWithinPartitions("url", "pos").write.mode("overwrite").parquet(f"{path}/url_index")


def write_index(centroids: DataFrame, assigned: DataFrame, path: str, file_rows: int = INDEX_FILE_ROWS) -> bool:
    """Vector index, passages in one folder per cell; an empty index is not written.

    A cell is written as so many files as its size asks for: one for a small cell, and many
    tasks share a cell that holds a third of the corpus. The table of sizes has one row per
    cell.
    """
    if assigned.isEmpty():
        return False
    sizes = assigned.groupBy("cell").agg(F.ceil(F.count("*") / file_rows).cast("int").alias("_n"))
    sizes = checkpointed(sizes, "cell-sizes")
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    dealt = assigned.join(F.broadcast(sizes), "cell").withColumn("_file", F.pmod(F.xxhash64("id"), F.col("_n")))
    dealt.repartition("cell", "_file").drop("_n", "_file").write.mode("overwrite").option("maxRecordsPerFile", file_rows).partitionBy("cell").parquet(f"{path}/passages")
    return True


def write_rollouts(rows: DataFrame, path: str) -> None:
    """Training rows with their token arrays."""
    rows.write.mode("overwrite").parquet(path)
