"""Writers: tables, CSV, reports, the term cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxtable.sources import schemas
from voxtable.sources.stage import exists


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, key: str = "review_id") -> None:
    """Corpus bucketed by id: later per-review sums and joins need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)


def flat_for_csv(df: DataFrame) -> DataFrame:
    """Arrays and maps as JSON text, the only form CSV can hold."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    return df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    flat_for_csv(df).write.mode("overwrite").options(
        header="true", quote='"', escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)


def json_length(c) -> Column:
    return F.json_array_length(c)


def save_term_cache(cache: DataFrame, path: str) -> None:
    """Write the verdicts as a new version; earlier versions stay readable meanwhile."""
    spark = cache.sparkSession
    version = 0
    if exists(spark, path):
        version = spark.read.parquet(path).agg(F.max("version")).first()[0] + 1
    cache.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(path)


def save_report(report: DataFrame, path: str) -> None:
    """Append one report (schema ``schemas.REPORT``)."""
    report.write.mode("append").parquet(path)


def load_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REPORT).parquet(path)


def list_reports(reports: DataFrame) -> DataFrame:
    """One row per report, newest first."""
    per = reports.groupBy("report_ts", "dataset").agg(F.max("review_count").alias("review_count"),
                                                     F.count("*").alias("n_results"))
    named = per.withColumn("report_name", F.concat(F.lit("report_"), F.date_format("report_ts", "yyyyMMdd_HHmmss")))
    return named.orderBy(F.desc("report_ts"))


def load_report(reports: DataFrame, timestamp) -> DataFrame:
    return reports.where(F.col("report_ts") == timestamp)
