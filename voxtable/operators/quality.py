"""Checks on the prepared tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from voxtable.operators.labeling import dominant_label


def _row(name: str, ok: Column, message: Column, warning: bool = False) -> Column:
    ok = F.coalesce(ok, F.lit(False))
    return F.struct(F.lit(name).alias("name"), (ok | F.lit(warning)).alias("passed"),
                    (~ok & F.lit(warning)).alias("is_warning"), F.when(~ok, message).otherwise("").alias("message"))


def _presence(spark, name: str, table: DataFrame | None, hint: str) -> DataFrame:
    return spark.range(1).select(_row(name, F.lit(table is not None), F.lit(hint)).alias("r")).select("r.*")


def validation_report(spark, raw: DataFrame | None, corpus: DataFrame | None, sample: DataFrame | None,
                      labeled: DataFrame | None, curated: DataFrame | None, min_corpus: int = 10_000,
                      sample_per_rating: int = 20, max_share: float = 0.5, min_curated: int = 100) -> DataFrame:
    """(name, passed, is_warning, message), one aggregate per table. Warnings count as passed.

    ``sentences`` may be an array or JSON text; the JSON check reads every row.
    """
    out = [_presence(spark, "raw_exists", raw, "ingest the raw reviews first"),
           _presence(spark, "corpus_exists", corpus, "split the sentences first"),
           _presence(spark, "sample_exists", sample, "draw the sample first"),
           _presence(spark, "labeled_exists", labeled, "label the corpus first"),
           _presence(spark, "curated_exists", curated, "label the corpus first")]
    if corpus is not None:
        kinds = dict(corpus.dtypes)
        has = "sentences" in kinds
        bad = F.lit(0).cast("bigint")
        if kinds.get("sentences") == "string":
            bad = F.count_if(F.from_json("sentences", "array<string>").isNull())
        rows = [_row("corpus_size", F.col("n") >= min_corpus, F.format_string("corpus too small: %d", "n")),
                _row("sentences_column", F.lit(has), F.lit("no sentences column"))]
        if has:
            rows.append(_row("sentences_json", F.col("bad") == 0, F.format_string("%d malformed rows", "bad")))
        out.append(corpus.agg(F.count("*").alias("n"), bad.alias("bad")).select(F.inline(F.array(*rows))))
    if sample is not None:
        each = [F.count_if(F.col("rating") == r) == sample_per_rating for r in range(1, 6)]
        balanced = reduce(lambda a, b: a & b, each) | (F.count("*") == 5 * sample_per_rating)
        out.append(sample.agg(balanced.alias("ok")).select(
            _row("sample_balance", F.col("ok"), F.lit("uneven sample"), True).alias("r")).select("r.*"))
    if labeled is not None:
        out.append(dominant_label(labeled).select(_row(
            "topic_distribution", F.col("share") <= max_share,
            F.format_string("topic '%s' dominates", "dominant_label"), True).alias("r")).select("r.*"))
    if curated is not None:
        out.append(curated.agg(F.count("*").alias("n")).select(_row(
            "curated_size", F.col("n") >= min_curated, F.format_string("too few samples: %d", "n")).alias("r")).select("r.*"))
    return reduce(DataFrame.unionByName, out)


def overall(report: DataFrame) -> DataFrame:
    return report.agg(F.bool_and("passed").alias("ready"), F.count_if("passed").alias("passed"),
                      F.count("*").alias("total"), F.count_if("is_warning").alias("warnings"))
