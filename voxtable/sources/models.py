"""Fitted models as parquet tables with a metadata table beside them."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxtable.operators import classifier, hmm, tfidf
from voxtable.sources import schemas
from voxtable.sources.stage import complete


def metadata_row(spark: SparkSession, model: str, data_source: str, corpus_size: int, params: dict, metrics: dict,
                 trained_at: datetime | None = None) -> DataFrame:
    text = lambda d: {str(k): str(v) for k, v in d.items()}
    row = (model, trained_at or datetime.now(timezone.utc), data_source, corpus_size, text(params), text(metrics))
    return spark.createDataFrame([row], schemas.METADATA)


def _write(df: DataFrame, path: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{name}")


def _read(spark: SparkSession, path: str, name: str, columns: list[str]) -> DataFrame:
    target = f"{path}/{name}"
    if not complete(spark, target):
        raise FileNotFoundError(f"no fitted model table at {target}")
    df = spark.read.parquet(target)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise TypeError(f"{target} is not this kind of model: no column {', '.join(missing)}")
    return df


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The metadata table, empty when the model was saved without one."""
    target = f"{path}/metadata"
    return spark.read.parquet(target) if complete(spark, target) else spark.createDataFrame([], schemas.METADATA)


def _save(parts: dict, path: str, metadata: DataFrame | None) -> None:
    for name, df in parts.items():
        _write(df, path, name)
    if metadata is not None:
        _write(metadata, path, "metadata")


def _facts(spark: SparkSession, m: tfidf.TfidfModel) -> DataFrame:
    return spark.createDataFrame([(m.n_docs, m.max_features, m.stop_words)],
                                 "n_docs bigint, max_features int, stop_words array<string>")


def save_tfidf(model: tfidf.TfidfModel | None, path: str, metadata: DataFrame | None = None,
               postings: DataFrame | None = None) -> None:
    if model is None:
        raise RuntimeError("cannot save an unfitted model")
    spark = model.vocabulary.sparkSession
    parts = {"vocabulary": model.vocabulary, "facts": _facts(spark, model)}
    if postings is not None:
        # Sorted by term inside each file: a query reads only the row groups of its own terms.
        parts["postings"] = postings.repartition(F.col("term"), F.pmod(F.xxhash64("review_id"), F.lit(32))) \
            .sortWithinPartitions("term")
    _save(parts, path, metadata)


def load_tfidf(spark: SparkSession, path: str) -> tfidf.TfidfModel:
    facts = _read(spark, path, "facts", ["n_docs", "max_features", "stop_words"]).first()
    vocab = _read(spark, path, "vocabulary", ["term", "total", "df", "idf"])
    return tfidf.TfidfModel(vocab, facts["n_docs"], facts["max_features"], facts["stop_words"])


def load_postings(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "postings", ["review_id", "term", "weight"])


def save_classifier(model: classifier.NaiveBayesModel | None, path: str, metadata: DataFrame | None = None) -> None:
    if model is None:
        raise RuntimeError("cannot save an unfitted model")
    spark = model.terms.sparkSession
    facts = _facts(spark, model.tfidf).withColumn("classes", F.array(*[F.lit(c) for c in model.classes])) \
        .withColumn("alpha", F.lit(model.alpha))
    _save({"class_terms": model.terms, "priors": model.priors, "vocabulary": model.tfidf.vocabulary, "facts": facts},
          path, metadata)


def load_classifier(spark: SparkSession, path: str) -> classifier.NaiveBayesModel:
    facts = _read(spark, path, "facts", ["classes", "alpha"]).first()
    terms = _read(spark, path, "class_terms", ["term", "idf", "logp"])
    return classifier.NaiveBayesModel(terms, _read(spark, path, "priors", ["priors"]), load_tfidf(spark, path),
                                      facts["classes"], facts["alpha"])


def save_probabilities(model: DataFrame | None, path: str, metadata: DataFrame | None = None) -> None:
    if model is None:
        raise RuntimeError("cannot save an unfitted model")
    _save({"joint_counts": model}, path, metadata)


def load_probabilities(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "joint_counts", ["topic", "sentiment", "rating_category", "n"])


def save_hmm(spark: SparkSession, model: hmm.HmmModel | None, path: str, metadata: DataFrame | None = None) -> None:
    if model is None:
        raise RuntimeError("cannot save an unfitted model")
    _save({"parameters": hmm.parameter_table(spark, model)}, path, metadata)


def load_hmm(spark: SparkSession, path: str) -> hmm.HmmModel:
    return hmm.from_parameter_table(_read(spark, path, "parameters", ["kind", "from_state", "to_state", "p"]))


def model_overview(metadata: DataFrame) -> DataFrame:
    """One row per model (its latest training), plus the latest training time over all models."""
    latest = metadata.groupBy("model").agg(F.max_by(F.struct("corpus_size", "params", "metrics"), "trained_at").alias("m"),
                                           F.max("trained_at").alias("trained_at"))
    text = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), ", ")
    newest = latest.agg(F.max("trained_at")).scalar()
    return latest.select("model", F.col("m.corpus_size").alias("corpus_size"), text(F.col("m.params")).alias("parameters"),
                         text(F.col("m.metrics")).alias("metrics"), "trained_at", newest.alias("latest_trained_at"))


def retrain_needed(metadata: DataFrame, current: DataFrame, max_change: float = 0.10, min_accuracy: float = 0.70) -> DataFrame:
    """(model, current_size, accuracy) against the metadata: retrain when the corpus changed by
    more than 10 % or the accuracy is under 70 %."""
    joined = metadata.select("model", "corpus_size").join(current, "model")
    change = F.abs(F.col("current_size") - F.col("corpus_size")) / F.col("corpus_size")
    return joined.select("model", "corpus_size", "current_size", change.alias("change"), "accuracy",
                         ((change > max_change) | (F.col("accuracy") < min_accuracy)).alias("retrain"))
