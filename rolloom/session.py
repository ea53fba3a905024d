"""Session helpers: the shared working folder, and written tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read and write, as named by ``spark.checkpoint.dir``.

    A local session without that setting (tests) gets a fresh temporary folder; a
    cluster session without it is an error, because a machine-local folder would
    not be visible to the other executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="rolloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/rolloom-{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting the lineage."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
