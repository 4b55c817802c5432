"""Shared scratch space and materialised intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a local one only where it is unset and all tasks run here.

    On a cluster a folder of this machine would be another one for each executor, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not root:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="voxtable-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/voxtable/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage with a table that survives lost executors; unlike an RDD checkpoint the
    result keeps column pruning and an exact size, so the optimizer broadcasts it only when
    it really is small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread an input with fewer splits than cores over all cores; otherwise leave it alone.

    A file with a single row group is read by one task, which would then do all text work. A
    large table has many more splits than cores and is not shuffled. The filter is always true;
    being non-deterministic it keeps costly later filters from moving below the exchange, back
    into that one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key).where(F.spark_partition_id() >= 0)


BROADCAST_ROWS = 200_000


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` when its proven row bound is small; otherwise the optimizer decides."""
    return F.broadcast(df) if max_rows <= BROADCAST_ROWS else df


def literal_table(spark: SparkSession, columns: dict) -> DataFrame:
    """A small in-plan table from Python lists; its size is known to the optimizer."""
    import pyarrow as pa

    return spark.createDataFrame(pa.table(columns))
