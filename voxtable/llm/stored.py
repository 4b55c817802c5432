"""Stored intermediate tables whose shuffle files go as soon as the table is written."""

from __future__ import annotations

from pyspark.sql import DataFrame

from voxtable.sources.scratch import materialize

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back; what its job shuffled is deleted when the job ends."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return materialize(df, name)
    finally:
        conf.set(CLEANUP, before)
