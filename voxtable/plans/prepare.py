"""Preparation: ingest, clean, split, sample, label, validate. One write per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxtable.operators import cleaning, labeling, quality, sampling
from voxtable.sources import corpus, sinks
from voxtable.sources.stage import complete, run_stage


def prepare(spark: SparkSession, raw_json: str, root: str, force: bool = False, lexicon: dict | None = None) -> dict:
    """Runs the stages that are missing (all of them with ``force``); {stage: ran}."""
    at = lambda name: f"{root.rstrip('/')}/{name}.parquet"
    read = spark.read.parquet
    stages = [
        ("raw", lambda: corpus.ingest_with_ids(spark, raw_json)),
        ("clean", lambda: cleaning.clean(read(at("raw")))),
        ("main", lambda: cleaning.with_sentences(read(at("clean")))),
        ("sample", lambda: sampling.rating_sample(read(at("main")))),
        ("labeled", lambda: labeling.auto_label(read(at("main")), lexicon)),
        ("curated", lambda: labeling.curation_table(sampling.curation_sample(read(at("labeled"))))),
    ]
    return {name: run_stage(spark, at(name), build, sinks.write_parquet, force) for name, build in stages}


def validate(spark: SparkSession, root: str, **limits) -> DataFrame:
    at = lambda name: f"{root.rstrip('/')}/{name}.parquet"
    table = lambda name: spark.read.parquet(at(name)) if complete(spark, at(name)) else None
    return quality.validation_report(spark, table("raw"), table("main"), table("sample"), table("labeled"),
                                     table("curated"), **limits)
