"""Files of the shared store, opened inside tasks."""

from __future__ import annotations

from pyspark.sql import SparkSession


def qualified(spark: SparkSession, root: str) -> str:
    """A path with its scheme; one without is on the default file system, as Spark reads it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def open_store(path: str):
    """File system and inner path of a path that names its scheme.

    A path without one means the default file system, which tasks do not know: it is refused
    instead of being taken for a local path.
    """
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        raise ValueError(f"{path} names no file system")
    return fs.FileSystem.from_uri(path)
