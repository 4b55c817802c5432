"""Path checks and stages that run once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def complete(spark: SparkSession, path: str) -> bool:
    """A finished output: a plain file, or a folder with its success marker."""
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        return False
    return fs.getFileStatus(p).isFile() or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))


def run_stage(spark: SparkSession, output: str, build: Callable[[], DataFrame], write: Callable[[DataFrame, str], None],
              force: bool = False) -> bool:
    """Build and write unless the output is already there. True when it ran.

    The check looks for the success marker, so a stage that died half-way runs again.
    """
    if complete(spark, output) and not force:
        return False
    write(build(), output)
    return True
